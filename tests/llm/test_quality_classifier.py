import zlib

import numpy as np

from matrixloom.llm import quality_classifier as Q

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    out = Q.op4_quality_classifier(spark, SF).collect()
    assert len(out) == 1000
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(labels[r.doc_id], r.predicted, r.score) for r in out if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b, _ in held) / len(held) >= 0.97
    good, bad = ([s for a, _, s in held if a == k] for k in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) >= 0.98


def test_scorer_equals_plain_average(monkeypatch):
    monkeypatch.setattr(Q, "CACHE_WORDS", 60)
    rng = np.random.default_rng(1)
    values = rng.normal(size=Q.BUCKETS)
    scorer = Q.Scorer(values, 0.25)
    for n in (1, 2, 7, 400):
        words = [bytes(rng.integers(97, 123, rng.integers(1, 80), dtype=np.uint8)) if rng.random() < 0.5 else b"again" for _ in range(n)]
        f = Q.run_features([b" ".join(map(Q.trim, words))])
        want = 1 / (1 + np.exp(-(values[f].mean() + 0.25)))
        assert abs(scorer(b"  ".join(words)) - want) < 1e-9


def test_scorer_reads_the_middle_of_long_words(monkeypatch):
    values = np.random.default_rng(2).normal(size=Q.BUCKETS)
    scorer = Q.Scorer(values, 0.25)
    a, b = (b"x" * 500 + m + b"y" * 500 for m in (b"first", b"other"))
    for word in (a, b):
        text = b"some " + word + b" words"
        flat = [Q.word_features(text.split())[0], Q.pair_features(np.array([Q.xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64))]
        want = 1 / (1 + np.exp(-(values[np.concatenate(flat)].mean() + 0.25)))
        assert abs(scorer(text) - want) < 1e-9 and word not in scorer.words
    assert scorer(a) != scorer(b)
    whole = [scorer(w) for w in (a, b"k " + a + b" " + b)]
    for size in (64, 333, 1002):  # in parts, also with ends of some bytes
        monkeypatch.setattr(Q, "PART_BYTES", size)
        assert np.allclose([Q.Scorer(values, 0.25)(w) for w in (a, b"k " + a + b" " + b)], whole, atol=1e-12)


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = [b"a", b"bc", b"def", "\u00e9\u00e8".encode(), b"a", b"x" * 48]
    flat, sizes = Q.word_features(words)
    assert sizes.tolist() == [1 + sum(max(0, len(w) + 2 - n + 1) for n in (3, 4, 5)) for w in words]
    parts = np.split(flat, np.cumsum(sizes)[:-1])
    for w, p in zip(words, parts):
        assert Q.word_features([w])[0].tolist() == p.tolist()


def test_training_counts_whole_texts():
    rng = np.random.default_rng(3)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 80), dtype=np.uint8)) for _ in range(3000)]
    buckets, shares = Q.unpack(Q.feature_counts(b" ".join(words)))
    plain = np.bincount(Q.run_features([b" ".join(words)]), minlength=Q.BUCKETS)
    assert buckets.tolist() == np.flatnonzero(plain).tolist() and np.allclose(shares, plain[buckets] / plain.sum())


def test_junk_in_a_part_of_long_texts_is_learnt(spark):
    rng = np.random.default_rng(5)
    common = ["word%d" % i for i in range(50)]
    rows = []
    for i in range(12):
        words = rng.choice(common, 3000).tolist()
        if i % 2:
            words[2000:2300] = ["zqxjunk"] * 300
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    values, _ = Q.fit(docs, labels)
    own = Q.word_features([b"zqxjunk"])[0]
    usual = Q.word_features([w.encode() for w in common])[0]
    assert values[own].mean() < values[usual].mean() - 0.1
    assert not Q.fit(docs, labels, max_train_bytes=0)[0].any()


def test_edges(spark):
    rows = [(1, None), (1, None), (2, ""), (3, " \n"), (4, "x" * 100000), (5, "a b " * 40000), (None, "text")]
    docs = spark.createDataFrame([(d, t, 0.5, 1) for d, t in rows], "doc_id long, text string, score double, quality int")
    for labels in ([], [(5, 1, 0)], [(1, 1, 0), (2, 0, 0), (4, 1, 0), (5, 0, 1), (9, 1, 1), (5, None, 1)]):
        labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        out = Q.quality_scores(docs, labels).collect()
        assert len(out) == 7 and len({r.score for r in out if r.doc_id in (1, 2, 3)}) == 1
    assert Q.quality_scores(docs.limit(0), labels).count() == 0
