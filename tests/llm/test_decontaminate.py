import random

import numpy as np

from matrixloom.llm import decontaminate as D

SF = "/root/testdata/sf0.01"


def brute_tile(a, b, least):
    """Textbook greedy string tiling over all pairs of positions."""
    fa, fb, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best, places = 0, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and fa[i + n] and fb[j + n]:
                    n += 1
                if n > best:
                    best, places = n, [(i, j)]
                elif n == best and n:
                    places.append((i, j))
        if best < least:
            return covered
        for i, j in places:
            if all(fa[i : i + best]) and all(fb[j : j + best]):
                fa[i : i + best] = fb[j : j + best] = [False] * best
                covered += best


def brute(docs, items, least=D.MATCH, threshold=D.THRESHOLD):
    out = set()
    for d, t in docs:
        for i, s in items:
            w = D.tokens(s.encode()) if s else []
            x = D.tokens(t.encode()) if t else []
            if w and d is not None:
                grams = {tuple(x[j : j + min(least, len(w))]) for j in range(len(x))}
                if any(tuple(w[j : j + min(least, len(w))]) in grams for j in range(len(w) - min(least, len(w)) + 1)):
                    n = brute_tile(w, x, min(least, len(w)))
                    if n >= threshold * len(w):
                        out.add((d, i, len(w), n))
    return out


def result(df):
    return {(r.doc_id, r.item_id, r.n_item_words, r.n_tiled) for r in df.collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    want = brute([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    assert want and result(D.op10_decontaminate(spark, SF)) == want


def test_reordered_and_cut_passages(spark):
    rng = random.Random(7)
    vocab = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(8, 30)))) for i in range(8)] + [(20, "w1 w2"), (21, ""), (22, None), (23, "...")]
    docs = []
    for n in range(60):
        w = items[n % 8][1].split()
        cut = rng.randint(1, len(w) - 1)
        passage = w[cut:] + ["X"] * (n % 3) + w[:cut] if n % 2 else w[: cut + 3]
        docs.append((n, " ".join([rng.choice(vocab) for _ in range(rng.randint(0, 30))] + [x.upper() + "," for x in passage])))
    docs += [(100, None), (101, ""), (102, " .. "), (103, "w1 w2 " * 3000), (104, "w1. W2!"), (0, docs[0][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, item_id int, seed string")
    bench = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    want = brute([d for d in docs if d[0] != 103], items) | {(103, 20, 2, 2)}
    got = result(D.contaminated(df, bench))
    assert {r for r in got if r[0] != 103 or r[1] == 20} == want
    assert result(D.contaminated(df, bench, broadcast_chars=0)) == got
    assert D.contaminated(df.limit(0), bench).count() == 0 and D.contaminated(df, bench.limit(0)).count() == 0


def test_tile_matches_textbook():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = (rng.integers(1, 5, rng.integers(5, 25)).astype(np.uint64) for _ in range(2))
        least = int(rng.integers(2, 5))
        assert D.tile(a, b, least) == brute_tile(a.tolist(), b.tolist(), least)


def test_items_of_few_words_among_marks_are_joined(spark):
    """Seed lengths follow the words that count, not blanks."""
    docs = spark.createDataFrame([(1, "x a b y"), (2, "x b a y")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "- - - | | a b * * #")], "item_id long, text string")
    for chars in (1 << 20, 0):
        assert [(r.doc_id, r.item_id) for r in D.contaminated(docs, items, broadcast_chars=chars).collect()] == [(1, 7)]


def test_equal_words_take_no_square_time():
    import time

    begun = time.perf_counter()
    same, long = np.full(1000, 7, np.uint64), np.full(20_000, 7, np.uint64)
    assert D.tile(same, long) == 1000 and D.tile(long, same) == 1000
    index = D.Index([(1, b"a " * 1000), (2, b"a b " * 500)])
    assert [(i.item_id, n) for i, n in index.matches(D.word_hashes(D.tokens(b"a " * 20_000)), 0.6)] == [(1, 1000)]
    assert [(i.item_id, n) for i, n in index.matches(D.word_hashes(D.tokens(b"a b " * 10_000)), 0.6)] == [(2, 1000)]
    assert time.perf_counter() - begun < 10


def test_rows_without_ids(spark):
    words = "the quick brown fox jumps over the lazy dog today"
    docs = spark.createDataFrame([(None, f"x {words} y", 1), (None, "clean", 2), (5, "clean", 3), (5, words.upper(), 4), (6, None, 5), (7, "", 6)], "doc_id long, text string, rid int")
    items = spark.createDataFrame([(None, words), (3, words), (4, None)], "item_id long, text string")
    for chars in (1 << 20, 0):
        got = {(r.doc_id, r.item_id, r.n_tiled) for r in D.contaminated(docs, items, broadcast_chars=chars).collect()}
        assert got == {(None, None, 10), (None, 3, 10), (5, None, 10), (5, 3, 10)}
        kept = D.without_leaks(docs, items, broadcast_chars=chars)
        assert kept.columns == docs.columns and sorted(r.rid for r in kept.collect()) == [2, 3, 5, 6]
        assert D.without_leaks(docs.limit(0), items, broadcast_chars=chars).count() == 0
        assert D.without_leaks(docs, items.limit(0), broadcast_chars=chars).count() == 6
