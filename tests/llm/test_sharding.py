import zlib
from collections import defaultdict

import pytest
import xxhash

from matrixloom.llm import sharding as S


def check(rows, df, shards=8):
    got = df.collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    want = sorted((d if d is not None else -1, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in got) == want
    total = sum(w[1] for w in want)
    by = defaultdict(list)
    for r in got:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        by[r.shard].append(r)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    # brute force: shard boundaries on the whole order; small groups of equal texts as a whole
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    order = sorted((signed(xxhash.xxh64_intdigest((t or "").encode(), 42)), d if d is not None else -(1 << 63), size(t)) for d, t in rows)
    cum, expect, group, start = 0, defaultdict(int), defaultdict(int), {}
    for h, _, s in order:
        group[h] += s
    for h, d, s in order:
        small = group[h] * shards <= S.WHOLE * total
        expect[d, s, min(shards - 1, (start.setdefault(h, cum) if small else cum) * shards // total)] += 1
        cum += s
    for r in got:
        expect[r.doc_id if r.doc_id is not None else -(1 << 63), r.size, r.shard] -= 1
    assert not any(expect.values())


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], S.shard(docs))


@pytest.mark.parametrize("ranges", [(32, 8192), (1, 2)])
def test_hot_and_odd_rows(spark, monkeypatch, ranges):
    monkeypatch.setattr(S, "RANGES", ranges)
    monkeypatch.setattr(S, "RANGE_ROWS", 40)
    rows = [(i, "the same text") for i in range(300)] + [(7, "repeated row")] * 200 + [(1000 + i, "x" * (i * 37 % 900)) for i in range(300)]
    rows += [(None, None), (None, "n"), (5, None), (6, ""), (8, "é" * 50000)]
    df = spark.createDataFrame([(d, t, 1, "s") for d, t in rows], "doc_id long, text string, shard int, size string")
    check(rows, S.shard(df))


def test_small_groups_stay_whole(spark):
    rows = [(i * 7 + j, f"text {i} " * (i % 9)) for i in range(400) for j in range(i % 5 + 1)]
    df = S.shard(spark.createDataFrame(rows, "doc_id long, text string"))
    check(rows, df)
    of_text, got, size = dict(rows), defaultdict(set), defaultdict(int)
    for r in df.collect():
        got[of_text[r.doc_id]].add(r.shard)
        size[of_text[r.doc_id]] += r.size
    small = [t for t, n in size.items() if n * 8 <= S.WHOLE * sum(size.values())]
    assert len(small) > 200 and all(len(got[t]) == 1 for t in small) and len(set.union(*got.values())) == 8


def test_empty(spark):
    assert S.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLES", 1)
    monkeypatch.setattr(S, "RANGE_ROWS", 20)
    rows = [(i, "small") for i in range(3000)] + [(5000 + i, "x" * 20000) for i in range(20)]
    check(rows, S.shard(spark.createDataFrame(rows, "doc_id long, text string")))
