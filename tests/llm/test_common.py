import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from matrixloom.llm import _common as C


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\t\n\x0b\x0c\r\x1c\x85\xa0 x"), max_size=40))
def test_words_follow_the_rule(text):
    assert [w.decode() for w in C.words_of(text.encode())] == re.findall(r"[^\x20\x09-\x0D]+", text)


def test_gram_hashes_tell_sequences_apart():
    h = C.word_hashes([b"a", b"b", b"a", b"b", b"c"])
    g = C.gram_hashes(h, 2)
    assert g[0] == g[2] and len(set(g.tolist())) == 3 and len(C.gram_hashes(h, 6)) == 0
    assert C.gram_hashes(np.concatenate([h, h]), 5)[0] == C.gram_hashes(h, 5)[0]


def test_parts_of_batches():
    texts = ["x" * 10, None, "y" * 25, "", "z", "z" * 9, "é" * 3]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], names=["i", "t"])
    got = [p.column(1).to_pylist() for p in C.parts([batch, batch.slice(0, 0)], 10)]
    assert got == [["x" * 10, None], ["y" * 25], ["", "z", "z" * 9], ["é" * 3]] and sum(got, []) == texts


def test_sieved_semi_join(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id % 400 as doc_id", "id as text", "'x' as __word2")
    ids = spark.createDataFrame([(i,) for i in (3, 5, 5, 399, 77777, None)], "doc_id long")
    want = sorted((r.doc_id, r.text) for r in df.join(ids.distinct(), "doc_id", "left_semi").collect())
    for bits in (1 << 23, 64, 1 << 12):
        monkeypatch.setattr(C, "MAP_BITS", bits)
        got = C.only(df, ids, "doc_id")
        assert got.columns == df.columns and sorted((r.doc_id, r.text) for r in got.collect()) == want


def test_scratch_tables(spark):
    s = C.Scratch(spark, "t")
    kept = s.keep(spark.range(5), "a")
    assert kept.count() == 5 and s.keep(spark.range(0), "b").count() == 0
    s.drop("a", "missing")
