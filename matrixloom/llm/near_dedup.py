"""MinHash near-duplicates by a multi-index Hamming join, confirmed on full shingle sets.

Every document has k minimum hashes of b bits. Two documents are d apart when d of their k
slots differ. The k slots are split into m chunks; by the pigeonhole principle a pair at most
r apart has a chunk with at most e = r // m differing slots, so each chunk is indexed under
every way of leaving e of its slots out. All pairs at most r apart therefore share an index key.
Candidates at most r apart are confirmed on their full shingle sets.

Hot keys: equal shingle sets are collapsed first. In rounds, every member of a key that holds several
components is then tried against one representative, the one it shares most keys with (no pairs
within a group), and components are contracted. When a round links nothing more, the keys that still
hold several components are compared across components, in blocks of bounded size: the largest
component's members with the others', and the others' among themselves. A pair comes from the first key
that it shares only.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U64, Scratch, binary, gram_hashes, mix, odd_multipliers, only, parts, table, word_hashes, words_of

SHINGLE, SLOTS, BITS, CHUNKS, MAX_DIFFERENT = 5, 64, 16, 16, 31
#: Members of an index key that one task compares at once.
BLOCK = 512
#: Rounds of trying members against representatives end after so many, or when one finds less than this share of the
#: links; what they leave unlinked is compared in full.
MAX_TURNS, LEAST_SHARE = 4, 0.05
#: Links up to which one task finds the components (3 MB); more go through rounds of joins.
ONE_TASK_LINKS = 200_000


def shingle_set(text: bytes | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes: of every k words, of the whole sequence if there are fewer, none without words."""
    words = words_of(text.lower()) if text else []  # bytes.lower() changes A-Z only
    if not words:
        return np.empty(0, U64)
    h = word_hashes(words)
    return np.unique(gram_hashes(h, min(k, len(words))) + U64(min(k, len(words))))


_MULTIPLIERS = odd_multipliers(SLOTS, 101)[:, None]


def signature(shingles: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """b = 16 bits of the minimum of each slot's permutation of the shingle hashes."""
    best = np.full(slots, np.iinfo(np.uint64).max, U64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096]
        np.minimum(best, ((part[None, :] ^ (part[None, :] >> U64(29))) * _MULTIPLIERS[:slots]).min(axis=1), out=best)
    return (mix(best) & U64((1 << BITS) - 1)).astype(np.uint16)


def _fingerprints(batches):
    for batch in parts(batches):
        sizes, digests, sigs = [], [], []
        for text in binary(batch.column(1)).to_pylist():
            s = shingle_set(text)
            sizes.append(len(s))
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "sig"],
        )


def _plan(slots: int, chunks: int, different: int) -> list[tuple[int, ...]]:
    """The slots of each index key: of every chunk, all choices that leave out the allowed errors."""
    allowed = different // chunks
    keys = []
    for c in np.array_split(np.arange(slots), chunks):
        if len(c) <= allowed:
            raise ValueError("too many allowed errors for chunks of this size")
        keys += [tuple(int(i) for i in kept) for kept in combinations(c, len(c) - allowed)]
    return keys


def _taken(different: int, chunks: int) -> np.ndarray:
    """_plan as a rectangle; shorter keys repeat a slot."""
    plan = _plan(SLOTS, chunks, different)
    width = max(map(len, plan))
    return np.array([p + (p[0],) * (width - len(p)) for p in plan])


def _index_keys(different: int, chunks: int):
    """Rows (key, way, id): way is the position of the key in _plan."""
    take = plan = _taken(different, chunks)
    width = take.shape[1]
    salt = mix(np.arange(1, len(plan) + 1, dtype=U64))
    mult = odd_multipliers(width, 7)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, SLOTS).astype(U64)
            h = np.zeros((n, len(plan)), U64)
            for i in range(width):
                h += (sig[:, take[:, i]] + U64(1)) * mult[i]
            key = mix(h + salt[None, :]).view(np.int64).ravel()
            ids = np.repeat(batch.column(0).to_numpy(), len(plan))
            way = np.tile(np.arange(len(plan), dtype=np.int32), n)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(way), pa.array(ids)], names=["key", "way", "id"])

    return run


def _close(different: int):
    """Candidate pairs whose signatures differ in at most `different` slots."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, SLOTS) for i in (2, 3))
            ok = pa.array((a != b).sum(axis=1) <= different)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return run


def _blocks(different: int, chunks: int, percent: int | None):
    """Works on members of one block pair of a key: pairs of other components, close signatures and no earlier shared key.

    Without `percent`, rows (key, p, q, id) of the members of such pairs; with it, rows (a, b) of the pairs whose
    32-bit shingle sets allow the similarity. Batches come sorted by (key, p, q); a group goes on across batches.
    """
    take = _taken(different, chunks)
    group = ("key", "p", "q")
    columns = (*group, "side", "way", "id", "comp", "sig") + (("n", "shingles") if percent else ())

    def close(rows):
        ids, comp, sig, way = rows["id"], rows["comp"], rows["sig"], rows["way"][0]
        left, right = np.flatnonzero(rows["side"] == 0), np.flatnonzero(rows["side"] == 1)
        whole = rows["p"][0] == rows["q"][0]
        for n, i in enumerate(left):
            j = left[n + 1 :] if whole else right
            j = j[(comp[j] != comp[i]) & (ids[j] != ids[i])]
            same = sig[j] == sig[i]
            near = same.shape[1] - same.sum(axis=1) <= different
            j, same = j[near], same[near]
            if len(j):
                j = j[same[:, take].all(axis=2).argmax(axis=1) == way]
            if len(j):
                yield i, j

    def members(rows):
        hit = np.zeros(len(rows["id"]), bool)
        for i, j in close(rows):
            hit[i] = True
            hit[j] = True
        return [rows[c][hit] for c in (*group, "id")]

    def similar(rows):
        n, ids = rows["n"], rows["id"]
        sets = [np.frombuffer(x, np.uint32) for x in rows["shingles"]]
        size = np.array([len(x) for x in sets])
        a, b = [], []
        for i, j in close(rows):
            own, others = sets[i], np.concatenate([sets[x] for x in j])
            hit = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            # shingles of one set that share 32 bits could hide as many common ones
            both = np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(size[j])[:-1]])) + (n[i] - size[i]) + (n[j] - size[j])
            j = j[100 * both >= percent * (n[i] + n[j] - both)]
            a.append(np.minimum(ids[i], ids[j]))
            b.append(np.maximum(ids[i], ids[j]))
        return [np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b)]

    solve, names = (similar, ["a", "b"]) if percent else (members, [*group, "id"])

    def run(batches):
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in columns if n != "sig"}
            rows["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
            if rest is not None:
                rows = {n: np.concatenate([rest[n], rows[n]]) for n in rows}
            change = np.flatnonzero(np.any([np.diff(rows[n]) != 0 for n in group], axis=0)) + 1
            starts = np.concatenate([[0], change])
            done = [solve({n: v[a:b] for n, v in rows.items()}) for a, b in zip(starts[:-1], starts[1:]) if b - a > 1]
            rest = {n: v[starts[-1] :] for n, v in rows.items()}
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*done)], names=names)
        if rest is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in solve(rest)], names=names)

    return run


def _short_sets(batches):
    """Distinct lower halves of the shingle hashes, sorted; n is the size of the full set."""
    for batch in parts(batches):
        sets = [shingle_set(t) for t in binary(batch.column(1)).to_pylist()]
        short = [np.unique(s.astype(np.uint32)).tobytes() for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(short, pa.binary())], names=["id", "n", "shingles"])


def _sets(batches):
    for batch in parts(batches):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([shingle_set(t).tobytes() for t in binary(batch.column(1)).to_pylist()], pa.binary())], names=["id", "shingles"]
        )


def _confirm(percent: int):
    def run(batches):
        for batch in parts(batches):
            ok = []
            for i in range(batch.num_rows):  # views into the batch: sets are not copied
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), U64) for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])

    return run


def _unite(batches):
    """(id, comp) of links that fit one task."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    ids = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([find(x) for x in ids], pa.int64())], names=["id", "comp"])


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(id, comp): comp is the smallest id reachable over edges (a, b); only ids with an edge appear.

    Few links are united in one task. Otherwise every root hooks to the smallest neighbouring root and chains of
    parents are halved, alternately, so the number of rounds grows with the logarithm of a component's size; all
    state is in written tables.
    """
    edges = scratch.keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-edges0")
    if edges.limit(ONE_TASK_LINKS + 1).count() <= ONE_TASK_LINKS:
        return scratch.keep(edges.repartition(1).mapInArrow(_unite, "id long, comp long"), f"{name}-labels")
    labels = scratch.keep(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("comp", F.col("id")), f"{name}-labels0")
    step = 0
    while True:
        if edges.isEmpty():
            break
        step += 1
        # each root takes the smallest root next to it, then chains of parents are shortened
        parent = edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("up"))
        parent = scratch.keep(parent, f"{name}-parent{step}-0")
        jump = 0
        while True:
            jump += 1
            nxt = scratch.keep(
                parent.alias("p").join(parent.select(F.col("root").alias("r2"), F.col("up").alias("up2")), F.col("p.up") == F.col("r2"), "left")
                .select("root", F.coalesce("up2", "up").alias("up"), F.col("up2").isNotNull().alias("moved")),
                f"{name}-parent{step}-{jump}",
            )
            scratch.drop(f"{name}-parent{step}-{jump - 1}")
            moved = not nxt.where("moved").isEmpty()
            parent = nxt.drop("moved")
            if not moved:
                break
        new_labels = scratch.keep(
            labels.join(parent.withColumnRenamed("root", "comp"), "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")), f"{name}-labels{step}"
        )
        up = lambda side: parent.select(F.col("root").alias(side), F.col("up").alias(f"u{side}"))
        new_edges = (
            edges.join(up("a"), "a", "left").join(up("b"), "b", "left")
            .select(F.coalesce("ua", "a").alias("x"), F.coalesce("ub", "b").alias("y")).where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        new_edges = scratch.keep(new_edges, f"{name}-edges{step}")
        scratch.drop(f"{name}-edges{step - 1}", f"{name}-labels{step - 1}", f"{name}-parent{step}-{jump}")
        edges, labels = new_edges, new_labels
    return labels


def _dealt(scratch: Scratch, members: DataFrame, sigs: DataFrame) -> DataFrame:
    """Rows (key, p, q, side, way, id, comp, sig) of the pairs of blocks in which keys of several components are compared.

    members: key, way, id, comp. The members of a key's largest component (group 0) are not compared among
    themselves, so they are dealt to the blocks of the others only, and the others (group 1) to theirs and to each
    other: a stranger in a key of n linked members makes some n rows. Pairs of blocks of the others have p and q from
    0, those with the largest component have p below 0. Others of one component are not compared either.
    """
    of_comp = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    keys = of_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("comps")).where("comps > 1")
    blocks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    keys = scratch.keep(keys.select("key", F.col("top.comp").alias("top"), blocks(F.col("top.n")).alias("b0"), blocks(F.col("n") - F.col("top.n")).alias("b1"), (F.col("comps") > 2).alias("several")), "open")
    m = members.join(keys, "key").withColumn("first", F.col("comp") == F.col("top"))
    m = m.withColumn("own", F.pmod(F.xxhash64("id"), F.when(F.col("first"), F.col("b0")).otherwise(F.col("b1"))).cast("int"))
    pair = lambda p, q, side: F.struct(p.cast("int").alias("p"), q.cast("int").alias("q"), side.cast("int").alias("side"))
    other = lambda n: F.sequence(F.lit(0), n - 1)
    with_others = F.transform(other(F.col("b1")), lambda q: pair(-1 - F.col("own"), q, F.lit(0)))
    with_first = F.transform(other(F.col("b0")), lambda p: pair(-1 - p, F.col("own"), F.lit(1)))
    among = F.transform(other(F.col("b1")), lambda q: pair(F.least("own", q), F.greatest("own", q), F.col("own") > q))
    to = F.when(F.col("first"), with_others).when(F.col("several"), F.concat(with_first, among)).otherwise(with_first)
    rows = m.select("key", "way", "id", "comp", F.explode(to).alias("to")).select("key", "to.p", "to.q", "to.side", "way", "id", "comp")
    return rows.join(sigs, "id").select("key", "p", "q", "side", "way", "id", "comp", "sig")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, different: int = MAX_DIFFERENT, chunks: int = CHUNKS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row.

    Nulls, empty and blank texts have no shingles and stay alone. A text of fewer than five words is one
    shingle; texts of any length are read whole. Equal texts and equal shingle sets share a component. Rows that repeat a doc_id are versions of
    one document and share its component. Rows without a doc_id are linked by equal sets only and kept if
    no other row has their set. Other columns of `docs` are ignored, whatever their names.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    prints = scratch.keep(base.mapInArrow(_fingerprints, "doc_id long, n_shingles long, digest binary, sig binary"), "prints")

    # one class per distinct set; its id is the smallest doc_id
    classes = scratch.keep(prints.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes")
    sigs = classes.where("id is not null").select("id", "sig")

    keyed = sigs.mapInArrow(_index_keys(different, chunks), "key long, way int, id long")
    # written, so that the join's sides are both plain exchanges and Spark can split a hot key's side
    met = scratch.keep(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "met")
    shared = scratch.keep(keyed.join(met, "key"), "shared")
    scratch.drop("met")

    def texts(ids: DataFrame) -> DataFrame:
        return only(base, ids, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Links among candidate pairs, by the full sets of the documents in them."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
        sets = scratch.keep(texts(wanted).mapInArrow(_sets, "id long, shingles binary"), f"{name}-sets")
        x, y = (sets.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
        links = scratch.keep(pairs.join(x, "a").join(y, "b").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long"), f"{name}-links")
        scratch.drop(f"{name}-sets")
        return links

    comp = sigs.select("id", F.col("id").alias("comp"))
    links, n_links = None, 0

    def members() -> DataFrame:
        return shared.join(comp, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def merge(new: DataFrame, name: str) -> None:
        nonlocal links, comp
        links = new if links is None else links.union(new)
        comp = components(scratch, links, name)

    for turn in range(MAX_TURNS):
        m = scratch.keep(members(), f"members{turn}")
        heads = m.groupBy("key").agg(F.min(F.struct("comp", F.xxhash64("id", F.lit(turn)), "id")).alias("h"), F.max("comp").alias("hi")).where("h.comp <> hi")
        heads = heads.select("key", F.col("h.comp").alias("head_comp"), F.col("h.id").alias("head"))
        often = m.join(heads, "key").where("comp <> head_comp").groupBy("id", "head").agg(F.count("*").alias("n"))
        best = often.groupBy("id").agg(F.max(F.struct("n", -F.col("head"))).alias("m")).select(F.least("id", -F.col("m.col2")).alias("a"), F.greatest("id", -F.col("m.col2")).alias("b")).distinct()
        x, y = (sigs.select(F.col("id").alias(c), F.col("sig").alias(f"sig_{c}")) for c in "ab")
        pairs = best.join(x, "a").join(y, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_close(different), "a long, b long")
        pairs = scratch.keep(pairs, f"stars{turn}")
        scratch.drop(f"members{turn}")
        new = confirmed(pairs, f"turn{turn}")
        n_new = new.count()
        if n_new:
            merge(new, f"turn{turn}")
            n_links += n_new
        if n_new <= LEAST_SHARE * n_links:
            break

    # keys that still hold several components: compare across components, in blocks
    dealt = scratch.keep(_dealt(scratch, members(), sigs), "dealt")
    scratch.drop("shared")
    order = ("key", "p", "q")
    grouped = lambda df: df.repartition(*order).sortWithinPartitions(*order)
    # first which members have a pair to compare, then those with their sets
    near = scratch.keep(grouped(dealt).mapInArrow(_blocks(different, chunks, None), "key long, p int, q int, id long"), "near")
    short = scratch.keep(texts(near.select(F.col("id").alias("doc_id")).distinct()).mapInArrow(_short_sets, "id long, n long, shingles binary"), "short")
    whole = dealt.join(near, [*order, "id"]).join(short, "id").select(*order, "side", "way", "id", "comp", "sig", "n", "shingles")
    found = scratch.keep(grouped(whole).mapInArrow(_blocks(different, chunks, percent), "a long, b long"), "found")
    scratch.drop("dealt", "near", "short")
    if not found.isEmpty():
        merge(confirmed(found, "last"), "last")

    component = classes.join(comp, "id", "left").select("digest", F.coalesce("comp", "id").alias("component"))
    out = prints.drop("sig").join(component, "digest", "left").withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op1_near_dedup": op1_near_dedup}
ORACLE_SQL = {
    "op1_near_dedup": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(CASE WHEN len(w) < 5 THEN w ELSE list_slice(w, i, i + 4) END, ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.id),
m AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.id = d.doc_id"""
}
