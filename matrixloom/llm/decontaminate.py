"""Benchmark decontamination by greedy string tiling.

A document and a test item that share a seed of MATCH words are compared: the longest common runs of
words that are still unmarked in both are marked, again and again, down to runs of MATCH words; they are
found by running Karp-Rabin hashes over the unmarked words. The tiles may lie in any order, so reordered
passages count. An item whose words are covered to THRESHOLD by tiles contaminates the document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U64, Scratch, binary, gram_hashes, odd_multipliers, only, parts, table, word_hashes

MATCH, THRESHOLD = 5, 0.6
#: Total bytes of test items up to which their seeds are broadcast (some seven times as much); beyond, seeds are joined.
BROADCAST_CHARS = 8 << 20

STRIP = b".,;:!?\"'()[]{}<>|*#-_"


def tokens(text: bytes | None) -> list[bytes]:
    """Words in lower case (A-Z) without punctuation around them; words of punctuation alone are no tokens."""
    return [t for w in text.lower().split() if (t := w.strip(STRIP))] if text else []


class Item:
    def __init__(self, item_id, hashes: np.ndarray):
        self.item_id, self.h = item_id, hashes


BASE = int(odd_multipliers(1, 5)[0])
INVERSE = U64(pow(BASE, -1, 1 << 64))


def _powers(base, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n - 1, 0), base, U64)]))[:n]


def _rolling(h: np.ndarray, s: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of s words: differences of prefix sums, brought to one power of the base (64-bit arithmetic)."""
    prefix = np.concatenate([np.zeros(1, U64), np.cumsum(h * _powers(U64(BASE), len(h)))])
    n = len(h) - s + 1
    return (prefix[s:] - prefix[:n]) * _powers(INVERSE, n)


def tile(item: np.ndarray, doc: np.ndarray, least: int = MATCH) -> int:
    """Words of item covered by greedy tiles of at least `least` words; item and doc are word hashes."""
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    covered, most = 0, min(len(item), len(doc))
    while size := _longest(item, doc, free_i, free_d, least, most):
        covered += _mark(item, doc, free_i, free_d, size)
        most = size
    return covered


def _open(free: np.ndarray, s: int) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(free)])
    return np.flatnonzero(c[s:] - c[:-s] == s)


def _longest(item, doc, free_i, free_d, least, most) -> int:
    """Length of the longest common unmarked runs, 0 below `least`; by bisection over the length."""
    lo, hi, best = least, most, 0
    while lo <= hi:
        mid = (lo + hi) // 2
        a, b = _open(free_i, mid), _open(free_d, mid)
        if len(a) and len(b) and np.isin(_rolling(item, mid)[a], _rolling(doc, mid)[b]).any():
            best, lo = mid, mid + 1
        else:
            hi = mid - 1
    return best


def _mark(item, doc, free_i, free_d, s) -> int:
    """Marks common runs of s words, by place in the item and then in the document, unless an earlier one took their words.

    Equal runs of the document are a list that is walked once: a place that is taken stays so.
    """
    a, b = _open(free_i, s), _open(free_d, s)
    ha, hb = _rolling(item, s)[a], _rolling(doc, s)[b]
    order = np.argsort(hb, kind="stable")
    lo, hi = np.searchsorted(hb[order], ha), np.searchsorted(hb[order], ha, "right")
    places, reached, covered, end = b[order], {}, 0, 0
    for i, first, last in zip(a[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
        if i < end:
            continue  # an earlier tile took some of these words
        j = reached.get(first, first)
        while j < last and not free_d[places[j] : places[j] + s].all():
            j += 1
        reached[first] = j
        if j < last and (item[i : i + s] == doc[places[j] : places[j] + s]).all():
            end = i + s
            free_i[i:end] = free_d[places[j] : places[j] + s] = False
            covered += s
    return covered


class Index:
    """Seeds of test items: sorted hashes of MATCH words (or of a whole shorter item), with item and place."""

    def __init__(self, items: list[tuple], least: int = MATCH):
        self.items, seeds = [], []
        for item_id, text in items:
            h = word_hashes(tokens(text))
            if not len(h):
                continue
            self.items.append(Item(item_id, h))
            k = min(least, len(h))
            g = gram_hashes(h, k)
            seeds.append(np.stack([g, np.full(len(g), len(self.items) - 1, U64), np.arange(len(g), dtype=U64), np.full(len(g), k, U64)]))
        self.least = least
        s = np.concatenate(seeds, axis=1) if seeds else np.empty((4, 0), U64)
        s = s[:, np.argsort(s[0], kind="stable")]
        self.seed, self.item, self.place, self.k = s[0], s[1].astype(np.int64), s[2].astype(np.int64), s[3].astype(np.int64)
        self.lengths = sorted(set(self.k.tolist()))

    def hits(self, h: np.ndarray):
        """(items, places, owners, positions, k) of the seeds of k words in a document: an item and place for each place in an
        item, an owner (an item) and position for each place in the document; never one for each pair of places."""
        for k in self.lengths:
            g = gram_hashes(h, k)
            if not len(g):
                continue
            lo = np.searchsorted(self.seed, g)
            at = np.flatnonzero((lo < len(self.seed)) & (self.seed[np.minimum(lo, len(self.seed) - 1)] == g))
            if not len(at):
                continue
            seeds, own = np.unique(g[at], return_inverse=True)
            lo, hi = np.searchsorted(self.seed, seeds), np.searchsorted(self.seed, seeds, "right")
            which = np.repeat(np.arange(len(seeds)), hi - lo)
            rows = np.arange(len(which)) + np.repeat(lo - np.cumsum(hi - lo) + (hi - lo), hi - lo)
            rows, which = rows[self.k[rows] == k], which[self.k[rows] == k]
            n = np.bincount(own, minlength=len(seeds))
            by_seed, first = at[np.argsort(own, kind="stable")], np.cumsum(n) - n
            pairs = np.unique(np.stack([self.item[rows], which]), axis=1)
            size = n[pairs[1]]
            positions = by_seed[np.arange(size.sum()) + np.repeat(first[pairs[1]] - np.cumsum(size) + size, size)]
            yield self.item[rows], self.place[rows], np.repeat(pairs[0], size), positions, k

    def matches(self, h: np.ndarray, threshold: float):
        """(item, covered words) of the items that reach the threshold."""
        found = list(self.hits(h))
        for item in np.unique(np.concatenate([f[0] for f in found])).tolist() if found else ():
            words = self.items[item].h
            in_item, in_doc = np.zeros(len(words) + 1, np.int64), np.zeros(len(h) + 1, np.int64)
            for items, places, owners, positions, k in found:
                for edge, at in ((in_item, places[items == item]), (in_doc, positions[owners == item])):
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + k, -1)
            if np.count_nonzero(np.cumsum(in_item) > 0) < threshold * len(words):
                continue  # tiles cover no words without a seed
            # tiles lie in runs of seeded positions; a gap keeps runs apart
            at = np.flatnonzero(np.cumsum(in_doc) > 0)
            cut = np.flatnonzero(np.diff(at) > 1) + 1
            gap = np.zeros(1, U64)
            doc = np.concatenate([x for part in np.split(h[at], cut) for x in (part, gap)])
            covered = tile(words, doc, min(self.least, len(words)))
            if covered >= threshold * len(words):
                yield self.items[item], covered

    def any(self, h: np.ndarray, threshold: float) -> bool:
        return next(self.matches(h, threshold), None) is not None


NAMES = ["doc_id", "item_id", "n_item_words", "n_tiled"]


def _emit(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=NAMES)


def _scan(index: Index, threshold: float):
    def run(batches):
        for batch in parts(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)).to_pylist()):
                h = word_hashes(tokens(text))
                rows += [(doc, item.item_id, len(item.h), covered) for item, covered in index.matches(h, threshold)]
            yield _emit(rows)

    return run


def _without(index: Index, threshold: float, at: int):
    def run(batches):
        for batch in parts(batches):
            texts = binary(batch.column(at).cast(pa.string())).to_pylist()
            yield batch.filter(pa.array([not index.any(word_hashes(tokens(t)), threshold) for t in texts], pa.bool_()))

    return run


def _seeds(least: int, lengths: tuple[int, ...]):
    """Rows (rid, seed): distinct seed hashes of a text, of all given lengths."""

    def run(batches):
        for batch in parts(batches):
            texts = binary(batch.column(1)).to_pylist()
            seeds = [np.unique(np.concatenate([gram_hashes(h, k) for k in lengths])).view(np.int64) for h in (word_hashes(tokens(t)) for t in texts)]
            rows = np.repeat(np.arange(len(texts)), [len(x) for x in seeds])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.concatenate(seeds))], names=["rid", "seed"])

    return run


def _item_seeds(least: int):
    """Rows (item, seed, k, reach, n): each item's distinct seeds of its own length k, the words that a seed can cover, the item's words."""

    def run(batches):
        for batch in parts(batches):
            out = [[] for _ in range(5)]
            for item, text in zip(batch.column(0).to_pylist(), binary(batch.column(1)).to_pylist()):
                h = word_hashes(tokens(text))
                k = min(least, len(h))
                if k:
                    seeds, times = np.unique(gram_hashes(h, k), return_counts=True)
                    for column, values in zip(out, (np.full(len(seeds), item), seeds.view(np.int64), np.full(len(seeds), k), times * k, np.full(len(seeds), len(h)))):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64) if c else [], pa.int64()) for c in out], names=["item", "seed", "k", "reach", "n"])

    return run


def _listed(least: int, threshold: float):
    def run(batches):
        for batch in parts(batches):
            rows, rids = [], []
            for rid, doc, text, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary(batch.column(2)).to_pylist(), batch.column(3).to_pylist()):
                h = word_hashes(tokens(text))
                index = Index([(x["item_id"], x["item_text"].encode()) for x in items], least)
                rows += [(doc, item.item_id, len(item.h), covered) for item, covered in index.matches(h, threshold)]
                rids += [rid] * (len(rows) - len(rids))
            yield pa.RecordBatch.from_arrays([*_emit(rows).columns, pa.array(rids, pa.int64())], names=[*NAMES, "rid"])

    return run


SCHEMA = "doc_id long, item_id long, n_item_words long, n_tiled long"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()


def _index(items: DataFrame, least: int, broadcast_chars: int) -> Index | None:
    """The items' seeds, or None if the items have more than broadcast_chars bytes."""
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size > broadcast_chars:
        return None
    return Index([(r.item_id, r.text.encode()) for r in items.orderBy("item_id", "text").collect()], least)


def _joined(scratch: Scratch, base: DataFrame, items: DataFrame, least: int, threshold: float) -> DataFrame:
    """SCHEMA and rid of all matches, by a join on seeds; base: rid, doc_id, text.

    A hot seed's side is split by Spark. Pairs whose shared seeds could not cover enough of the item go before
    any text moves; a document's text then moves once, with the texts of its items.
    """
    items = scratch.keep(items.withColumn("item", F.monotonically_increasing_id()), "items")
    of_items = scratch.keep(items.select("item", "text").mapInArrow(_item_seeds(least), "item long, seed long, k long, reach long, n long"), "item-seeds")
    lengths = tuple(sorted(r.k for r in of_items.select("k").distinct().collect())) or (least,)  # at most `least` values
    of_docs = base.select("rid", "text").mapInArrow(_seeds(least, lengths), "rid long, seed long")
    pairs = of_docs.join(of_items, "seed").groupBy("rid", "item").agg(F.sum("reach").alias("reach"), F.first("n").alias("n"))
    pairs = pairs.where(F.col("reach") >= threshold * F.col("n")).select("rid", "item")
    listed = pairs.join(items.withColumnRenamed("text", "item_text"), "item").groupBy("rid").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    listed = scratch.keep(listed, "listed")
    texts = only(base, listed, "rid").join(listed, "rid").select("rid", "doc_id", "text", "items")
    return texts.mapInArrow(_listed(least, threshold), SCHEMA + ", rid long")


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = MATCH, threshold: float = THRESHOLD, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """doc_id, item_id, n_item_words, n_tiled, coverage: one row per distinct document and test item that reaches the threshold.

    Nulls, empty texts and texts of punctuation alone match nothing. An item of fewer than `least` words must
    occur whole. Repeated rows give one row; rows without a doc_id, and items without an item_id, count as one
    each. Texts of any length are read whole. Other columns of either table are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = _items(benchmark)
    index = _index(items, least, broadcast_chars)
    if index:
        found = base.mapInArrow(_scan(index, threshold), SCHEMA)
    else:
        scratch = Scratch(docs.sparkSession, "decontaminate")
        base = scratch.keep(base.where("text is not null").withColumn("rid", F.monotonically_increasing_id()), "rows")
        found = _joined(scratch, base, items, least, threshold)
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("n_item_words", "n_tiled"), F.col("n_tiled") / F.col("n_item_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.n_item_words", "m.n_tiled", (F.col("m.n_tiled") / F.col("m.n_item_words")).alias("coverage"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", least: int = MATCH, threshold: float = THRESHOLD, broadcast_chars: int = BROADCAST_CHARS) -> DataFrame:
    """The rows of docs whose text holds no test item; every row is judged on its own text, with or without an id."""
    items = _items(benchmark)
    index = _index(items, least, broadcast_chars)
    if index:
        return docs.mapInArrow(_without(index, threshold, docs.columns.index(text_col)), docs.schema)
    scratch = Scratch(docs.sparkSession, "decontaminate")
    rows = scratch.keep(docs.select(F.struct(*docs.columns).alias("row")).withColumn("rid", F.monotonically_increasing_id()), "rows")
    base = rows.select("rid", F.lit(None).cast("long").alias("doc_id"), F.col(f"row.`{text_col}`").cast("string").alias("text")).where("text is not null")
    leaks = scratch.keep(_joined(scratch, base, items, least, threshold).select("rid").distinct(), "leaks")
    return rows.join(leaks, "rid", "left_anti").select("row.*")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLE_SQL: dict[str, str] = {}
