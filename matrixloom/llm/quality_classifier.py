"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A text's features are its words, its pairs of neighbouring words (a word that follows itself gives one
feature whatever the word) and the character n-grams of its words, all hashed into one table of
learned vectors. Their average goes through a softmax layer.
Training reads a bounded sample of the labelled rows (``max_train_rows``, spread by hash over all
of them, balanced by weights); scoring reads every row. A linear layer on an average is an average of
per-feature numbers, so scoring needs one number per feature: a table of fixed size that each worker
receives, whatever the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import MIX1, U64, Scratch, binary, mix, odd_multipliers, parts, release, table, word_hashes, words_of

BUCKETS, DIM = 1 << 16, 12
GRAMS = (3, 5)
#: Words that a scorer remembers (some 40 MB); longer ones than WORD_BYTES are scored whole but not remembered.
CACHE_WORDS, WORD_BYTES = 200_000, 48
#: Features are made for so many bytes at once; a longer word comes in parts.
PART_BYTES = 1 << 18
#: Labelled rows that training reads at most (the smallest hashes of doc_id), each whole, and bytes of their
#: counted features that the driver holds at most (fewer rows if texts are so long).
MAX_TRAIN_ROWS, MAX_TRAIN_BYTES = 5000, 64 << 20
#: At least so many passes and so many steps of so many rows.
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 500, 32, 0.4, 11
THRESHOLD = 0.3


def trim(word: bytes) -> bytes:
    """A word as features see it: whole, whatever its length."""
    return word


_MULTIPLIERS = odd_multipliers(GRAMS[1] + 1, 41)


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, sizes): of each word, then of its character n-grams with ends marked; sizes tell them apart."""
    marked = [b"<" + w + b">" for w in words]
    length = np.array([len(m) for m in marked], np.int64)
    byte = np.frombuffer(b"".join(marked), np.uint8).astype(U64) + U64(1)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(byte))  # bytes to the end of the own word
    owner = np.repeat(np.arange(len(words)), length)
    own, hashed = [np.arange(len(words))], [word_hashes(words)]
    for n in range(GRAMS[0], GRAMS[1] + 1):
        h = np.full(max(len(byte) - n + 1, 0), n, U64) * _MULTIPLIERS[-1]
        for k in range(n):
            h += byte[k : k + len(h)] * _MULTIPLIERS[k]
        whole = left[: len(h)] >= n
        own.append(owner[: len(h)][whole])
        hashed.append(mix(h[whole]))
    own, hashed = np.concatenate(own), np.concatenate(hashed)
    order = np.argsort(own, kind="stable")
    return (hashed[order] % U64(BUCKETS)).astype(np.int64), np.bincount(own, minlength=len(words))


def long_word_features(word: bytes):
    """The buckets of word_features([word]), in another order, some PART_BYTES n-grams of each size at a time."""
    yield np.array([xxhash.xxh3_64_intdigest(word) % BUCKETS], np.int64)
    marked = b"<" + word + b">"
    for a in range(0, len(marked), PART_BYTES):
        byte = np.frombuffer(marked, np.uint8, min(PART_BYTES + GRAMS[1] - 1, len(marked) - a), a).astype(U64) + U64(1)
        for n in range(GRAMS[0], GRAMS[1] + 1):
            h = np.full(min(max(len(byte) - n + 1, 0), PART_BYTES), n, U64) * _MULTIPLIERS[-1]
            for k in range(n):
                h += byte[k : k + len(h)] * _MULTIPLIERS[k]
            if len(h):
                yield (mix(h) % U64(BUCKETS)).astype(np.int64)


def feature_parts(words: list[bytes]):
    """(first word, buckets, sizes) of neighbouring words, PART_BYTES at a time; a longer word comes alone, several times."""
    a = 0
    while a < len(words):
        b, size = a, 0
        while b < len(words) and size + len(words[b]) <= PART_BYTES:
            size += len(words[b])
            b += 1
        if b > a:
            yield a, *word_features(words[a:b])
        else:
            b = a + 1
            for buckets in long_word_features(words[a]):
                yield a, buckets, np.array([len(buckets)])
        a = b


def pair_features(h: np.ndarray) -> np.ndarray:
    """Buckets of the pairs of neighbouring words; bucket 0 for a word that follows itself."""
    pair = (((h[:-1] * U64(3) + h[1:]) * MIX1 >> U64(20)) % U64(BUCKETS)).astype(np.int64)
    pair[h[:-1] == h[1:]] = 0
    return pair


def run_features(runs: list[bytes]) -> np.ndarray:
    out = [np.empty(0, np.int64)]
    for run in map(bytes.split, runs):
        if run:
            out += [*(p[1] for p in feature_parts(run)), pair_features(word_hashes(run))]
    return np.concatenate(out)


def feature_counts(text: bytes | None) -> bytes:
    """The buckets of all features of a text, counted: 4 bytes a count, then 2 bytes a bucket."""
    words, counts, part = words_of(text), np.zeros(BUCKETS, np.int64), 50_000
    for a in range(0, len(words), part):
        for _, buckets, _ in feature_parts(words[a : a + part]):
            counts += np.bincount(buckets, minlength=BUCKETS)
        h = word_hashes(words[max(a - 1, 0) : a + part])
        counts += np.bincount(pair_features(h), minlength=BUCKETS)
    own = np.flatnonzero(counts)
    return counts[own].astype(np.uint32).tobytes() + own.astype(np.uint16).tobytes()


def unpack(counted: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, share of each in the text's features)."""
    n = len(counted) // 6
    counts = np.frombuffer(counted, np.uint32, n)
    return np.frombuffer(counted, np.uint16, n, 4 * n).astype(np.int64), counts / max(1, counts.sum(dtype=np.int64))


def train(texts: list[bytes], labels: list[int]) -> tuple[np.ndarray, float]:
    """(value per feature bucket, bias) of the difference of the two softmax inputs; texts are counted features."""
    rng = np.random.default_rng(SEED)
    y = np.asarray(labels, np.int64)
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart: a constant near the only label
        return np.zeros(BUCKETS), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0)
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = rng.uniform(-0.5, 0.5, (DIM, 2)), np.zeros(2)
    per_epoch = -(-len(y) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // per_epoch))
    steps, total = 0, epochs * per_epoch
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for a in range(0, len(order), BATCH):
            rows = np.array([i for i in order[a : a + BATCH] if len(texts[i])], np.int64)
            rate = RATE * (1 - steps / total)
            steps += 1
            if not len(rows):
                continue
            parts = np.zeros((len(rows), BUCKETS))
            for part, i in zip(parts, rows):
                buckets, shares = unpack(texts[i])
                part[buckets] = shares
            hidden = parts @ vectors
            z = hidden @ layer + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            g = p * weight[rows][:, None]
            back = parts.T @ (g @ layer.T)
            layer -= rate * hidden.T @ g / 4
            bias -= rate * g.mean(axis=0) / 4
            vectors -= rate * 8 * back
    return vectors @ (layer[:, 1] - layer[:, 0]), float(bias[1] - bias[0])


class Scorer:
    """Scores of texts from per-feature values; sums over a word's own features are remembered."""

    def __init__(self, values: np.ndarray, bias: float):
        self.values, self.bias = values, bias
        self._start()

    def _start(self) -> None:
        self.words: dict[bytes, int] = {}
        self.used = 0
        self.hash, self.sum, self.n = np.zeros(4096, U64), np.zeros(4096), np.zeros(4096, np.int64)

    def _sums(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, sum of values and number of features of each word."""
        total, n = np.zeros(len(words)), np.zeros(len(words), np.int64)
        for a, buckets, sizes in feature_parts(words):
            total[a : a + len(sizes)] += np.add.reduceat(self.values[buckets], np.cumsum(sizes) - sizes)
            n[a : a + len(sizes)] += sizes
        return word_hashes(words), total, n

    def _add(self, words: list[bytes]) -> None:
        a, b = self.used, self.used + len(words)
        while b > len(self.hash):
            for name in ("hash", "sum", "n"):
                setattr(self, name, np.concatenate([getattr(self, name), np.zeros_like(getattr(self, name))]))
        self.hash[a:b], self.sum[a:b], self.n[a:b] = self._sums(words)
        self.words.update(zip(words, range(a, b)))
        self.used = b

    def __call__(self, text: bytes | None) -> float:
        words = words_of(text)
        if not words:
            return float(1 / (1 + np.exp(-self.bias)))
        total, count, last = 0.0, 0, np.empty(0, U64)
        for a in range(0, len(words), 50_000):  # in parts: the cache is emptied between them only
            part = words[a : a + 50_000]
            if len(self.words) + len(part) > CACHE_WORDS:
                self._start()
            at = list(map(self.words.get, part))
            long = []
            if None in at:
                new = dict.fromkeys(w for w, i in zip(part, at) if i is None)
                long = [w for w in new if len(w) > WORD_BYTES]
                self._add([w for w in new if len(w) <= WORD_BYTES])
                place = {w: -1 - i for i, w in enumerate(long)}  # below 0: not remembered
                at = [self.words[w] if i is None and w not in place else place[w] if i is None else i for w, i in zip(part, at)]
            at = np.array(at, np.int64)
            h, s, n = self.hash[at], self.sum[at], self.n[at]
            if long:
                for own, other in zip((h, s, n), self._sums(long)):
                    own[at < 0] = other[-1 - at[at < 0]]
            h = np.concatenate([last, h])
            total += s.sum() + self.values[pair_features(h)].sum()
            count += int(n.sum()) + len(h) - 1
            last = h[-1:]
        return float(1 / (1 + np.exp(-(total / count + self.bias))))


def _counted(batches):
    for batch in parts(batches):
        counted = [feature_counts(t) for t in binary(batch.column(1)).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counted, pa.binary())], names=["doc_id", "features"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS, max_train_bytes: int = MAX_TRAIN_BYTES) -> tuple[np.ndarray, float]:
    """Learns from whole texts of labelled rows that are not held out; at most `max_train_rows`, chosen by hash.

    Features are counted on the executors; the driver gets 6 bytes for each distinct bucket of a text, at most
    BUCKETS. Rows whose counts do not fit in `max_train_bytes` together, in order of hash, are left out of the sample.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id").mapInArrow(_counted, "doc_id long, features binary")
    scratch = Scratch(docs.sparkSession, "quality-classifier")
    rows = scratch.keep(rows.groupBy("doc_id").agg(F.min("features").alias("features")).join(F.broadcast(chosen), "doc_id"), "counted")
    sizes = rows.select("doc_id", F.octet_length("features").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect()
    taken = [r.doc_id for r, end in zip(sizes, np.cumsum([r.n for r in sizes])) if end <= max_train_bytes]
    if len(taken) < len(sizes):
        rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in taken], "doc_id long")), "doc_id", "left_semi")
    rows = rows.orderBy("doc_id").select("features", "quality").toArrow()
    scratch.drop("counted")
    model = train([x.as_buffer() for x in rows["features"]], rows["quality"].to_pylist())
    del rows
    release()
    return model


def score(docs: DataFrame, model: tuple[np.ndarray, float], *, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """docs with a column of scores added, from the whole text alone."""
    values, bias = model
    sent = docs.sparkSession.sparkContext.broadcast(values.astype(np.float32))  # BUCKETS numbers, 256 kB
    at = docs.columns.index(text_col)
    schema = docs.withColumn(out_col, F.lit(0.0)).schema

    def run(batches):
        scorer = Scorer(sent.value.astype(np.float64), bias)
        for batch in parts(batches):
            text = binary(batch.column(at).cast(pa.string()))
            scores = pa.array([scorer(t) for t in text.to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per input row.

    Nulls, empty and blank texts get the model's bias alone; texts and words of any length are read whole. Without labels, or with one label only, all
    scores are equal. Equal texts get equal scores. Other columns of `docs` are never read.
    """
    model = fit(docs, labels, id_col=id_col, text_col=text_col, max_train_rows=max_train_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = score(rows, model).select("doc_id", "score")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return out.select("doc_id", (F.coalesce(crc, F.lit(0)) % 5 == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
