"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control.

DataFrame functions only. Beside the fixed patterns, runs of 20 or more encoding characters that mix
letters and digits are tokens. The narrowest alphabet that holds a token is its inferred encoding.
Three tests ask whether its characters could be uniform draws from that alphabet: chi-squared
uniformity, Wald-Wolfowitz runs about the alphabet's middle, and lag-1 serial correlation; Fisher's
method joins their p-values. Random strings have uniform p-values and ordinary ones gather near 0,
so within each encoding and length class the corpus itself shows how many tokens are random: the
upper half of the p-values holds half of them. A class's cut is the smallest p-value at which the
estimated share of ordinary tokens among those above is at most `fdr`; short tokens, on which the
tests have little power, thereby need higher p-values or are not reported at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, table
from ._sql import let, matches, normal_tail

# Fixed patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{16,}"  # the same as runs [0-9a-f]+ of 16 or more
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "random")

TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
# Alphabets from narrow to wide; letters stand for themselves.
DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
ENCODINGS = (
    ("hex", DIGITS + LOWER[:6]),
    ("upper_hex", DIGITS + UPPER[:6]),
    ("base32", UPPER + "234567"),
    ("lower36", DIGITS + LOWER),
    ("upper36", DIGITS + UPPER),
    ("base62", DIGITS + UPPER + LOWER),
    ("base64", UPPER + LOWER + DIGITS + "+/"),
    ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
BINS = 20
FDR = 0.05
#: Fewer tokens than this in the upper half of a class's p-values say nothing about it.
LEAST_RANDOM = 3


def _found(text: Column, kind: str, pattern: str, group: int, may: Column) -> Column:
    hits = F.filter(matches(text, pattern, group), lambda m: F.length(m["part"]) >= LEAST[kind])
    rows = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))
    return F.when(may, rows).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _encoding(token: Column) -> Column:
    """Index of the narrowest alphabet that holds the token, null if none does."""
    out = F.lit(None).cast("int")
    for i, (_, alphabet) in reversed(list(enumerate(ENCODINGS))):
        out = F.when(F.length(F.translate(token, alphabet, "")) == 0, F.lit(i)).otherwise(out)
    return out


def p_random(token: Column, encoding: Column) -> Column:
    """Joint p-value of the tests that the token's characters are uniform draws from its alphabet."""
    alphabets = F.array(*[F.lit(a) for _, a in ENCODINGS])
    sizes = F.array(*[F.lit(float(len(a))) for _, a in ENCODINGS])

    def tests(x: Column, k: Column) -> Column:
        n = F.size(x).cast("double")
        squares = F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, c: s + let(F.size(F.filter(x, lambda y: y == c)).cast("double"), lambda m: m * m))
        uniform = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        high = F.size(F.filter(x, lambda y: y >= k / 2)).cast("double")
        low = n - high
        steps = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: ((a >= k / 2) != (b >= k / 2)).cast("double"))
        runs = 1 + F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)
        mean = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        middle = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
        power = F.aggregate(x, F.lit(0.0), lambda s, v: s + (v - middle) * (v - middle))
        lag = F.aggregate(F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: (a - middle) * (b - middle)), F.lit(0.0), lambda s, v: s + v)
        z = [uniform, F.abs(runs - mean) / spread, F.abs(F.when(power > 0, lag / power * F.sqrt(n) + 1 / F.sqrt(n)).otherwise(F.lit(99.0)))]
        tails = [normal_tail(z[0]), 2 * normal_tail(z[1]), 2 * normal_tail(z[2])]
        total = sum((-F.log(F.greatest(F.least(t, F.lit(1.0)), F.lit(1e-15))) for t in tails), F.lit(0.0))  # half of Fisher's statistic
        return let(total, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    def indices(alphabet: Column) -> Column:
        return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))

    return let(F.get(alphabets, encoding), lambda a: let(indices(a), lambda x: tests(x, F.get(sizes, encoding))))


def length_class(n: Column) -> Column:
    """Classes of doubling half-octaves: 20-27, 28-39, 40-55, ..."""
    return F.floor(2 * F.log2(n / F.lit(20.0))).cast("int")


def _tokens(text: Column) -> Column:
    seen = F.filter(matches(text, TOKEN), lambda m: m["text"].rlike("[0-9]") & m["text"].rlike("[A-Za-z]"))
    known = F.filter(F.transform(seen, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), _encoding(m["text"]).alias("enc"))), lambda m: m["enc"].isNotNull())
    scored = F.transform(
        known,
        lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["enc"].alias("enc"), length_class(F.length(m["text"])).alias("len"), p_random(m["text"], m["enc"]).alias("p")),
    )
    return F.when(text.rlike(TOKEN), scored).otherwise(F.array().cast("array<struct<start:int,end:int,enc:int,len:int,p:double>>"))


def cuts(tokens: DataFrame, fdr: float) -> DataFrame:
    """(enc, len, cut) for the classes in which some p-value keeps the false-discovery rate; at most encodings x classes rows."""
    binned = tokens.groupBy("enc", "len", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    halves = binned.groupBy("enc", "len").agg(F.sum(F.when(F.col("bin") >= BINS // 2, F.col("n")).otherwise(0)).alias("upper"), F.collect_list(F.struct("bin", "n")).alias("bins"))
    grid = F.sequence(F.lit(0), F.lit(BINS // 2))
    above = lambda t: F.aggregate("bins", F.lit(0).cast("long"), lambda s, b: s + F.when(b["bin"] >= t, b["n"]).otherwise(0))
    fits = F.filter(grid, lambda t: 1 - (1 - t / BINS) * 2 * F.col("upper") / F.greatest(above(t), F.lit(1)) <= fdr)
    return halves.where(F.col("upper") >= LEAST_RANDOM).select("enc", "len", (F.array_min(fits) / BINS).alias("cut")).where("cut is not null")


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans: one row per input row.

    Nulls and empty texts have no spans (the hash of an empty string); texts of any length are read whole,
    and repeated rows one by one. Spans are kind:start:end in code points, end exclusive, by start and then kind. A random span inside a fixed one is not repeated.
    Other columns of `docs` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    text = F.col("__text")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    scan = base.select(
        "doc_id",
        _found(text, "assign", ASSIGN, 2, text.rlike(ASSIGN)).alias("assign"),
        _found(text, "access", ACCESS, 0, text.contains("AKIA")).alias("access"),
        _found(text, "hex", HEX, 0, text.rlike(HEX)).alias("hex"),
        _tokens(text).alias("tokens"),
    )
    scan = scratch.keep(scan, "scan")
    limits = {(r.enc, r.len): r.cut for r in cuts(scan.select(F.inline("tokens")), fdr).collect()}
    cut = F.create_map(*[x for (e, n), c in limits.items() for x in (F.lit(f"{e}:{n}"), F.lit(c))]) if limits else F.lit(None).cast("map<string,double>")
    passing = F.filter("tokens", lambda t: t["p"] >= F.coalesce(F.get(F.array(cut), F.lit(0))[F.concat_ws(":", t["enc"].cast("string"), t["len"].cast("string"))], F.lit(2.0)))
    added = F.transform(passing, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    fixed = F.concat("assign", "access", "hex")
    new = F.filter(added, lambda a: ~F.exists(fixed, lambda b: (b["start"] <= a["start"]) & (a["end"] <= b["end"])))
    count = lambda c: F.size(c).cast("long")
    return scan.withColumn("random", new).select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        count("random").alias("n_random"),
        F.sha2(_text(fixed), 256).alias("base_sha256"),
        _text(F.concat(fixed, F.col("random"))).alias("spans"),
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


QUERIES = {"op3_secrets": op3_secrets}
ORACLE_SQL: dict[str, str] = {}
