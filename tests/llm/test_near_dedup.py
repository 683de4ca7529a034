import random
import re

import pytest
from pyspark.sql import functions as F

from matrixloom.llm import near_dedup as N

from .oracle import SF, same

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


def brute(rows):
    """{doc_id: (n_shingles, component)} by comparing all pairs of whole shingle sets."""
    sets = []
    for doc, text in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((doc, {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()))
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by_shingle = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            by_shingle.setdefault(g, []).append(i)
    seen = set()
    for group in by_shingle.values():
        for n, i in enumerate(group):
            for j in group[n + 1 :]:
                if (i, j) not in seen:
                    seen.add((i, j))
                    (a, x), (b, y) = sets[i], sets[j]
                    both = len(x & y)
                    if 100 * both >= 75 * (len(x) + len(y) - both):
                        p, q = sorted((find(a), find(b)))
                        up[q] = p
    return {d: (len(s), find(d)) for d, s in sets}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_matches_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    out = N.near_duplicates(docs)
    assert result(out) == want
    assert out.where(F.col("kept") != (F.col("doc_id") == F.col("component_id"))).count() == 0


def test_documents_match_sql(spark):
    assert same(N.op1_near_dedup(spark, SF), N.ORACLE_SQL["op1_near_dedup"]) == 1000


def test_chain_ties_and_hot_group(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    base = [rng.choice(vocab) for _ in range(60)]
    for _ in range(150):  # near copies at distances around the threshold
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        rows.append((doc, " ".join(w)))
        doc += 1
    for _ in range(60):  # a common passage in otherwise different texts
        rows.append((doc, " ".join(base[:20] + [rng.choice(vocab) for _ in range(30)])))
        doc += 1
    rows += [(1000 + i, "the same  TEXT\tof five\nwords") for i in range(50)] + [(1100, "The Same text OF FIVE words")]
    assert result(N.near_duplicates(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_components_in_rounds_equal_one_task(spark, monkeypatch, tmp_path):
    from matrixloom.llm._common import Scratch

    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = {(r.id, r.comp) for r in N.components(Scratch(spark, "t"), df, "one").collect()}
    monkeypatch.setattr(N, "ONE_TASK_LINKS", 3)
    assert one == {(r.id, r.comp) for r in N.components(Scratch(spark, "t"), df, "many").collect()}
    assert (1040, 1000) in one


def test_edges(spark):
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "two words"), (9, "TWO words"), (10, "two  words"), (11, "x " * 30000), (12, "É a b c d"), (13, "é a b c d")]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, id int")
    got = result(N.near_duplicates(df))
    assert got == brute(rows)
    assert got[5] == (0, 5) and got[6] == (0, 6) and got[10] == (1, 8)
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (3, "g h i j k l"), (3, "g h i j k l"), (None, "g h i j k l"), (None, None)]
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 0, True), (0, 0, True), (0, 0, True), (0, 3, False), (3, 3, True), (3, 3, True)]


def test_index_guarantee():
    """Every signature pair within the distance shares an index key."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, 64, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(64, 31, replace=False)
        b[at] ^= np.uint16(1)
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], names=["id", "sig"])
        out = next(N._index_keys(31, 16)([batch]))
        k, i = out.column(0).to_numpy(), out.column(2).to_numpy()
        assert set(k[i == 1]) & set(k[i == 2])
    with pytest.raises(ValueError):
        N._plan(64, 16, 64)


def test_a_stranger_among_linked_members_makes_few_rows(spark):
    """A key of many linked members and some others deals rows in proportion to its members."""
    from matrixloom.llm._common import Scratch

    n, sig = 20_000, b"\0" * 128
    members = spark.range(n + 3).selectExpr("id % 2 as key", "0 as way", "id", f"case when id < {n} then 0 else id end as comp")
    sigs = spark.range(n + 3).select("id", F.lit(sig).alias("sig"))
    dealt = N._dealt(Scratch(spark, "t"), members, sigs)
    assert dealt.count() <= n + 3 + 3 * (n // N.BLOCK + 4)
    # every pair of members of different components meets in one block pair of their key
    members = members.where(f"id % 500 = 0 or id >= {n}").withColumn("comp", F.expr(f"case when id < {n} then id div 8000 else id end"))
    size, N.BLOCK = N.BLOCK, 4
    try:
        rows = N._dealt(Scratch(spark, "t"), members, sigs).collect()
    finally:
        N.BLOCK = size
    groups = {}
    for r in rows:
        groups.setdefault((r.key, r.p, r.q), []).append(r)
    met = [frozenset((a.id, b.id)) for g in groups.values() for i, a in enumerate(g) for b in (g[i + 1 :] if g[0].p == g[0].q else g) if a.comp != b.comp and (g[0].p == g[0].q or (a.side, b.side) == (0, 1))]
    own = [(r.key, r.id, r.comp) for r in members.collect()]
    want = {frozenset((x, y)) for k, x, c in own for l, y, d in own if k == l and c != d}
    assert len(met) == len(set(met)) and set(met) == want
