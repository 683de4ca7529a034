"""Removal of every word covered by a repeated 35-word window, by prefix-partitioned suffix trees.

Only suffixes that can share a long prefix with another are brought together:

1. Every 35-word window has an anchor: the leftmost of its 28 inner 8-word grams with the smallest
   hash. Equal windows have equal anchors at equal offsets, so windows with an anchor gram that
   occurs once in the corpus are unique and are never shuffled.
2. Consecutive windows with one anchor form a block. The anchor's 8-word prefix is the partition
   key. Blocks of one key are a memory-sized group. For keys with more than GROUP_BLOCKS blocks, blocks
   of equal words are first counted as one, with map-side combination, and the different ones are
   split by a longer prefix: all 35 words.
3. In a group the suffix tree of the block suffixes is built from the root down, eight words an edge.
   Nodes with one leaf are dropped; internal nodes that reach 35 words are the repeats.
4. Texts with equal word sequences are taken once: all their windows repeat.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U64, Scratch, binary, gram_hashes, only, parts, table, word_hashes, words_of

WINDOW, GRAM = 35, 8
#: Blocks of one anchor gram that are put in one tree (some 13 MB of words); beyond, they are split by a longer prefix.
GROUP_BLOCKS = 32768
#: Blocks that a task holds at once.
BATCH_BLOCKS = 20_000

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def anchors_of(grams: np.ndarray) -> np.ndarray:
    """Position of each window's anchor: its leftmost smallest gram."""
    n = len(grams) + GRAM - WINDOW
    if n <= 0:
        return np.empty(0, np.int64)
    at, span, want = np.arange(len(grams)), 1, WINDOW - GRAM + 1
    while span < want:
        step = min(span, want - span)
        a, b = at[: len(at) - step], at[step:]
        at = np.where(grams[b] < grams[a], b, a)
        span += step
    return at[:n]


def _digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _prints(batches):
    for batch in parts(batches):
        n_words, digests, shas, keys, places, ends = [], [], [], [], [], [0]
        for text in binary(batch.column(1)).to_pylist():
            words = words_of(text)
            n_words.append(len(words))
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
            h = word_hashes(words)
            digests.append(_digest(h))
            if len(words) >= WINDOW:
                g = gram_hashes(h, GRAM)
                at = np.unique(anchors_of(g))
                keys.append(g[at].view(np.int64))
                places.append(at.astype(np.int32))
            ends.append(ends[-1] + (len(places[-1]) if len(words) >= WINDOW else 0))
        join = lambda parts, t: np.concatenate(parts) if parts else np.empty(0, t)
        lists = lambda v: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_words, pa.int64()), pa.array(digests, pa.binary()), pa.array(shas), lists(join(keys, np.int64)), lists(join(places, np.int32)), batch.column(2)],
            names=["doc_id", "n_words", "digest", "sha", "grams", "places", "none"],
        )


def _blocks(batches):
    """Blocks of the windows whose anchor gram occurs again; c1 and c2 name the words of blocks of crowded grams."""
    names = ["gram", "c1", "c2", "doc_id", "digest", "start", "words"]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary())
    for batch in parts(batches):
        out = [[] for _ in names]
        for doc, text, digest, places, crowded in zip(batch.column(0).to_pylist(), binary(batch.column(1)).to_pylist(), *(batch.column(i).to_pylist() for i in (2, 3, 4))):
            h = word_hashes(words_of(text))
            if _digest(h) != digest:
                continue
            g = gram_hashes(h, GRAM)
            at = anchors_of(g)
            state = np.zeros(len(g), np.int8)
            state[places] = 1
            state[np.asarray(places)[np.asarray(crowded, bool)]] = 2
            first = np.flatnonzero(np.diff(at, prepend=-1) != 0)
            last = np.append(first[1:], len(at))
            kind = state[at[first]]
            for a, b, k in zip(first[kind > 0].tolist(), last[kind > 0].tolist(), kind[kind > 0].tolist()):
                words = h[a : b + WINDOW - 1].tobytes()
                name = np.frombuffer(xxhash.xxh3_128_digest(words), np.int64).tolist() if k == 2 else (None, None)
                for column, value in zip(out, (int(g[at[a]].view(np.int64)), *name, doc, digest, a, words)):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types)], names=names)


def _windows(batches):
    """Rows (gram, c1, c2, many, inner, window): a hash of every window of each different block."""
    for batch in batches:
        h = [gram_hashes(np.frombuffer(w, U64), WINDOW, 29) for w in batch.column(4).to_pylist()]
        size = np.array([len(x) for x in h], np.int64)
        row = pa.array(np.repeat(np.arange(len(h)), size))
        inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        window = np.concatenate(h) if h else np.empty(0, U64)
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(row) for i in range(4)), pa.array(inner.astype(np.int32)), pa.array(window.view(np.int64))], names=["gram", "c1", "c2", "many", "inner", "window"])


def _runs(batches):
    """(gram, c1, c2, runs): runs of consecutive windows, as covered words of the block."""
    for batch in batches:
        runs = []
        for inner in batch.column(3).to_pylist():
            i = np.sort(inner)
            cut = np.flatnonzero(np.diff(i) > 1)
            runs.append([{"from": int(a), "to": int(b) + WINDOW} for a, b in zip(i[np.r_[0, cut + 1]], i[np.r_[cut, len(i) - 1]])])
        kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(runs, kind)], names=["gram", "c1", "c2", "runs"])


def _crowded_ranges(scratch: Scratch, blocks: DataFrame) -> DataFrame:
    name = ["gram", "c1", "c2"]
    contents = blocks.groupBy(*name).agg((F.count("*") > 1).alias("many"), F.first("words").alias("words"))
    contents = scratch.keep(contents, "contents")
    windows = contents.mapInArrow(_windows, "gram long, c1 long, c2 long, many boolean, inner int, window long")
    often = windows.groupBy("gram", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    partly = windows.where("not many").join(often, ["gram", "window"], "left_semi").groupBy(*name).agg(F.collect_list("inner").alias("inner"))
    partly = partly.mapInArrow(_runs, "gram long, c1 long, c2 long, runs array<struct<from:int,to:int>>")
    whole = contents.where("many").select(*name, F.array(F.struct(F.lit(0).alias("from"), F.expr("cast(octet_length(words) div 8 as int)").alias("to"))).alias("runs"))
    runs = scratch.keep(whole.unionByName(partly), "runs")
    found = blocks.select(*name, "doc_id", "digest", "start").join(runs, name).select("doc_id", "digest", "start", F.explode("runs").alias("r"))
    return found.select("doc_id", "digest", (F.col("start") + F.col("r.from")).alias("from"), (F.col("start") + F.col("r.to")).alias("to"))


def deep_nodes(keys: np.ndarray, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, window) of all windows below an internal node at depth WINDOW.

    words[offsets[i]:offsets[i + 1]] are the word hashes of block i, keys[i] its prefix key.
    """
    lengths = np.diff(offsets)
    windows = lengths - WINDOW + 1
    block = np.repeat(np.arange(len(windows)), windows)
    inner = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
    start = offsets[block] + inner
    grams = gram_hashes(words, GRAM)  # those that cross a block's end are never read
    node = keys[block]
    leaf = np.arange(len(start))
    depth = 0
    while depth < WINDOW and len(leaf):
        step = min(depth, WINDOW - GRAM)
        edge = grams[start[leaf] + step]
        order = np.lexsort((edge, node))
        n, e = node[order], edge[order]
        new = np.ones(len(order), bool)
        new[1:] = (n[1:] != n[:-1]) | (e[1:] != e[:-1])
        child = np.cumsum(new) - 1
        many = np.bincount(child)[child] > 1
        leaf, node = leaf[order[many]], child[many].astype(np.uint64)
        depth = step + GRAM
    return block[leaf], inner[leaf]


def _ranges(doc, digest, start, block, inner):
    """Rows (doc_id, digest, from, to) of covered words, one for each run of repeated windows of a block."""
    order = np.lexsort((inner, block))
    block, inner = block[order], inner[order]
    new = np.ones(len(block), bool)
    new[1:] = (block[1:] != block[:-1]) | (inner[1:] != inner[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(block)) - 1 if len(first) else first
    b = block[first]
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[b]), pa.array([digest[i] for i in b], pa.binary()), pa.array(start[b] + inner[first], pa.int32()), pa.array(start[b] + inner[last] + WINDOW, pa.int32())],
        names=["doc_id", "digest", "from", "to"],
    )


def _trees(batches):
    """Batches come sorted by gram; whole groups are worked on together, as one forest."""

    def solve(rows):
        raw = [r for part in rows for r in part[4]]
        key, doc, start = (np.concatenate([part[i] for part in rows]) for i in (0, 1, 3))
        digest = [d for part in rows for d in part[2]]
        words = np.frombuffer(b"".join(raw), U64)
        offsets = np.concatenate([[0], np.cumsum([len(r) // 8 for r in raw])]).astype(np.int64)
        return _ranges(doc, digest, start, *deep_nodes(key.view(np.uint64), words, offsets))

    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        part = (key, batch.column(1).to_numpy(), batch.column(2).to_pylist(), batch.column(3).to_numpy(), batch.column(4).to_pylist())
        held.append(part)
        count += len(key)
        cut = int(np.searchsorted(key, key[-1]))  # the last group may go on
        if count >= BATCH_BLOCKS and (cut or held[0][0][0] != key[-1]):
            held[-1] = tuple(x[:cut] for x in part)
            yield solve(held)
            held = [tuple(x[cut:] for x in part)]
            count = len(key) - cut
    if held:
        yield solve(held)


def _remove(batches):
    for batch in parts(batches):
        n_removed, shas, digests = [], [], []
        for text, marks in zip(binary(batch.column(1)).to_pylist(), batch.column(2).to_pylist()):
            words = words_of(text)
            digest = _digest(word_hashes(words))
            edge = np.zeros(len(words) + 1, np.int64)
            for m in marks:
                if m["digest"] == digest:
                    edge[m["from"]] += 1
                    edge[m["to"]] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            n_removed.append(int(gone.sum()))
            shas.append(hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist()) if not g])).hexdigest())
            digests.append(digest)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(n_removed, pa.int64()), pa.array(shas)], names=["doc_id", "digest", "removed", "kept_sha"])


def repeated_ranges(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(prints, ranges): one row per document, and the covered word ranges of documents whose sequence occurs once.

    docs: doc_id long, text string, none boolean (without an id of its own). prints: doc_id, none, n_words, digest, sha (of all words), copies.
    ranges: doc_id, digest, from, to (end exclusive), overlapping.
    """
    prints = scratch.keep(docs.mapInArrow(_prints, "doc_id long, n_words long, digest binary, sha string, grams array<long>, places array<int>, none boolean"), "prints")
    one = scratch.keep(prints.where(F.col("n_words") >= WINDOW).groupBy("digest").agg(F.min(F.struct("doc_id", "grams", "places")).alias("one"), F.count("*").alias("copies")), "one")
    spots = one.select("one.doc_id", "digest", "copies", F.explode(F.arrays_zip("one.grams", "one.places")).alias("at")).select("doc_id", "digest", F.col("at.grams").alias("gram"), F.col("at.places").alias("place"))
    # written, so that the join's sides are both plain exchanges and Spark can split a hot gram's side
    again = scratch.keep(spots.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"), "again")
    spots = spots.join(again, "gram").groupBy("doc_id", "digest").agg(F.collect_list("place").alias("places"), F.collect_list(F.col("n") > GROUP_BLOCKS).alias("crowded"))
    blocks = docs.join(spots, "doc_id").select("doc_id", "text", "digest", "places", "crowded")
    blocks = scratch.keep(blocks.mapInArrow(_blocks, "gram long, c1 long, c2 long, doc_id long, digest binary, start int, words binary"), "blocks")

    small = blocks.where("c1 is null").select("gram", "doc_id", "digest", "start", "words")
    ranges = small.repartition("gram").sortWithinPartitions("gram").mapInArrow(_trees, "doc_id long, digest binary, `from` int, `to` int")
    ranges = ranges.unionByName(_crowded_ranges(scratch, blocks.where("c1 is not null")))
    ranges = scratch.keep(ranges, "ranges")
    scratch.drop("again", "blocks", "contents", "runs")
    return prints.select("doc_id", "none", "n_words", "digest", "sha").join(one.select("digest", "copies"), "digest", "left"), ranges


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: one row per input row.

    Nulls, empty and blank texts have no words (the hash of an empty string). Texts shorter than a
    window lose nothing; texts of any length are read whole. Repeated rows are documents of their own, so
    all their windows repeat; so are rows without a doc_id. Other columns of `docs` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    given = F.col(id_col).cast("long")
    # a row without an id goes by its text's hash; every use of an id is checked by the digest of the words
    base = docs.select(F.coalesce(given, F.xxhash64(F.col(text_col).cast("string"))).alias("doc_id"), F.col(text_col).cast("string").alias("text"), given.isNull().alias("none"))
    prints, ranges = repeated_ranges(base, scratch)
    marks = ranges.join(prints.where("copies > 1").select("digest").distinct(), "digest", "left_anti")
    marks = marks.groupBy("doc_id").agg(F.collect_list(F.struct("digest", "from", "to")).alias("marks"))
    cut = only(base, marks, "doc_id").join(marks, "doc_id").select("doc_id", "text", "marks").mapInArrow(_remove, "doc_id long, digest binary, removed long, kept_sha string")
    cut = cut.dropDuplicates(["doc_id", "digest"])
    all_gone = F.coalesce(F.col("copies") > 1, F.lit(False))
    return prints.join(cut, ["doc_id", "digest"], "left").select(
        F.when(~F.col("none"), F.col("doc_id")).alias("doc_id"),
        "n_words",
        F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(all_gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha", "sha")).alias("kept_sha256"),
    )


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35),
x AS (SELECT s.r, s.i, array_to_string(list_slice(d.w, s.i, s.i + 34), ' ') AS k FROM s JOIN d USING (r)),
rep AS (SELECT k FROM x GROUP BY k HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, i + o AS p FROM (SELECT x.r, x.i, unnest(range(0, 35)) AS o FROM x JOIN rep USING (k))),
gone AS (SELECT r, list(p) AS ps, count(*) AS n FROM cov GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN g.r IS NULL THEN d.w ELSE list_filter(d.w, lambda x, i: NOT list_contains(g.ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone g USING (r)"""
}
