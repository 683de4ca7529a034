import sentencepiece

import corpus_pipeline
from matrixloom.llm import pieces, pii, quality_classifier

from . import test_decontaminate, test_near_dedup

SF = "/root/testdata/sf0.01"


def test_pipeline_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scores = {r.doc_id: r.predicted for r in quality_classifier.op4_quality_classifier(spark, SF).collect()}
    rows = {d: t for d, t in rows.items() if scores[d]}
    groups = test_near_dedup.brute(list(rows.items()))
    rows = {d: t for d, t in rows.items() if groups[d][1] == d}
    leaks = {d for d, *_ in test_decontaminate.brute(list(rows.items()), bench)}
    rows = {d: pii.redact(t) for d, t in rows.items() if d not in leaks}
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {d: lib.encode(t) for d, t in rows.items()}
    assert 0 < len(got) < 1000


def test_stages_keep_columns_and_odd_rows(spark):
    rows = [(1, "a clean text of some length, with a@b.com in it.", "en", "s", 1, "k"), (1, "a clean text of some length, with a@b.com in it.", "en", "s", 1, "k"), (2, None, None, None, None, "k"), (None, "x", "en", "s", 1, None), (3, "", "", "", 0, ""), (4, "long " * 30000, "en", "s", 0, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        ids = sorted(r.doc_id or 0 for r in out.collect())
        if name in ("benchmark leaks", "personal data"):
            assert ids == [0, 1, 1, 2, 3, 4]
        if name == "near duplicates":
            assert ids == [0, 1, 2, 3, 4]
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 6


def test_hot_groups_go_through_all_stages(spark, tmp_path):
    """A third of all rows are copies, as many near copies, and a passage and an address stand in most others."""
    import random

    rng = random.Random(3)
    vocab = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en'").select("text").orderBy("doc_id").limit(40).collect()]
    words = " ".join(vocab).split()
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, copy, base, passage = text(30), text(120), text(150).split(), text(60)
    rows = [(i, copy) for i in range(300)]
    for i in range(300, 600):
        w = list(base)
        w[rng.randrange(len(w))] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(i, f"{text(60)} {passage} {text(60)} mail a{i}@example.com " + (item if i % 9 == 0 else "")) for i in range(600, 900)]
    docs = spark.createDataFrame([(i, t, "en", "hot", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 900, 3)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()}
    groups = test_near_dedup.brute(rows)
    leaks = {d for d, *_ in test_decontaminate.brute([(d, t) for d, t in rows if d >= 600], [(1, item)])}
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert len(leaks) >= 30 and got == {d: lib.encode(pii.redact(t)) for d, t in rows if groups[d][1] == d and d not in leaks}
    assert 0 in got and 300 in got and sum(d < 600 for d in got) == 2


def test_rows_without_an_id_are_deduplicated_by_text(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1)), (5, text(1)), (3, text(1) + " end"), (None, text(2)), (None, text(2)), (None, text(3)), (None, None), (7, text(4)), (7, text(4)), (7, text(5))]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["near duplicates"](spark, docs, SF)
    assert sorted(((r.doc_id or 0, r.text) for r in out.collect()), key=str) == sorted([(3, text(1) + " end"), (0, text(2)), (0, text(3)), (0, None), (7, text(4)), (7, text(5))], key=str)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("keys=[__id") >= 2
