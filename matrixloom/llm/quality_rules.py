"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs them.

DataFrame functions only. Each rule votes good, bad or nothing on counts of a text. Bad texts are bad in
different ways, and one way makes few rules vote bad, so the latent classes are "good" and one way of
being bad for each rule. The corpus is reduced to the counts of its vote patterns (at most 3 to the
number of rules, whatever its size); over that table expectation-maximisation estimates the classes'
shares and each rule's accuracy, its chance of a bad vote, in each class. A text's posterior
probability of the good class replaces all-must-pass filtering.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, table
from ._sql import let, words

GRAM = 5
SYMBOLS = "#*$%&|<>"
ROUNDS, SETTLED = 30, 1e-3
#: Starting values: share of good texts; chances of a bad vote on a good text, by a bad kind's own rule, by others.
PRIOR, ON_GOOD, OWN, OTHERS = 0.8, 0.01, 0.9, 0.1
#: Bounds of all chances, and the most that a rule may err on good texts.
BOUNDS, MOST_ON_GOOD = (0.005, 0.995), 0.05


def repeated_words(w: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text, the first occurrence included."""
    n = F.size(w)
    hashed = F.transform(F.sequence(F.lit(0), n - GRAM), lambda i: F.struct(F.xxhash64(*[F.get(w, i + j) for j in range(GRAM)]).alias("h"), i.alias("i")))

    def doubles(s: Column) -> Column:
        near = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.filter(F.transform(s, lambda x, j: F.when(near(x, j - 1) | near(x, j + 1), x["i"])), lambda i: i.isNotNull()))

    def covered(at: Column) -> Column:
        start = F.struct(F.lit(-GRAM).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(GRAM), i - a["last"])).alias("n")), lambda a: a["n"])

    return F.when(n >= GRAM, let(F.array_sort(hashed), lambda s: covered(doubles(s)))).otherwise(F.lit(0))


def counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col("t")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            F.size(F.array_distinct(w)).alias("n_distinct"),
            F.size(F.filter(w, lambda x: (F.upper(x) == x) & (F.lower(x) != x))).alias("n_upper"),
            F.size(F.filter(w, lambda x: F.substring(x, -1, 1).isin(".", "!", "?"))).alias("n_ends"),
            repeated_words(w).alias("n_repeat_words"),
        )

    row = base.select(
        "doc_id",
        let(words(text), of_words).alias("w"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
    )
    row = row.select("doc_id", "w.*", "word_chars", "n_symbols", "l.*")
    return row.select("doc_id", *[F.col(c).cast("long") for c in row.columns[1:]])


def votes() -> dict[str, Column]:
    """1 for good, 0 for bad, -1 for no vote; a text without words gets a bad vote for its length alone."""
    n = F.col("n_words")
    share = lambda c: F.col(c) / F.greatest(n, F.lit(1))

    def vote(bad: Column, good: Column, enough: Column = n >= 10) -> Column:
        return F.when(~enough, -1).when(bad, 0).when(good, 1).otherwise(-1).cast("int")

    length = F.col("word_chars") / F.greatest(n, F.lit(1))
    lines = F.col("n_lines")
    return {
        "v_length": F.when(n < 10, 0).when(n >= 40, 1).otherwise(-1).cast("int"),
        "v_word_length": vote((length < 2.5) | (length > 12), (length >= 3) & (length <= 10)),
        "v_symbols": vote(share("n_symbols") > 0.1, share("n_symbols") < 0.02),
        "v_repeats": vote(5 * F.col("n_repeat_words") > n, 50 * F.col("n_repeat_words") < n),
        "v_lines": vote(10 * F.col("n_dup_lines") > 3 * lines, F.col("n_dup_lines") == 0, (n >= 10) & (lines >= 3)),
        "v_upper": vote(share("n_upper") > 0.4, share("n_upper") < 0.1),
        "v_ends": vote((share("n_ends") < 0.01) | (share("n_ends") > 0.5), (share("n_ends") > 0.02) & (share("n_ends") < 0.3), n >= 40),
        "v_variety": vote((F.col("n_distinct") < 0.2 * n) & (n < 2000) | (F.col("n_distinct") < 0.03 * n), F.col("n_distinct") > 0.3 * n),
    }


def start(n_rules: int) -> tuple[list[float], list[list[float]]]:
    """(shares, chances of a bad vote by class and rule) to begin with; class 0 is good."""
    shares = [PRIOR] + [(1 - PRIOR) / n_rules] * n_rules
    return shares, [[ON_GOOD] * n_rules] + [[OWN if i == j else OTHERS for j in range(n_rules)] for i in range(n_rules)]


def posteriors(v: Column, model: tuple[list[float], list[list[float]]]) -> Column:
    """array<double>: probability of each class given an array of votes. The model is one folded literal per array."""
    shares, chances = model
    n = len(chances[0])
    logs = lambda values: F.split(F.lit(",".join(repr(math.log(x)) for x in values)), ",").cast("array<double>")
    bad, good = logs(x for row in chances for x in row), logs(1 - x for row in chances for x in row)
    rules = F.sequence(F.lit(0), F.lit(n - 1))

    def weight(c: Column, share: Column) -> Column:
        one = lambda j: F.when(F.get(v, j) == 0, F.get(bad, c * n + j)).when(F.get(v, j) == 1, F.get(good, c * n + j)).otherwise(F.lit(0.0))
        return F.aggregate(rules, share, lambda a, j: a + one(j))

    weights = F.transform(logs(shares), lambda share, c: weight(c, share))
    scaled = let(weights, lambda w: F.transform(w, lambda x: F.exp(x - F.array_max(w))))
    return let(scaled, lambda w: F.transform(w, lambda x: x / F.aggregate(w, F.lit(0.0), lambda a, y: a + y)))


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[list[float], list[list[float]]]:
    """Expectation-maximisation over (votes array<int>, n); a round is one aggregation to classes x rules x votes rows."""
    first = patterns.select(F.max(F.size("votes"))).first()[0]
    if not first:
        return [1.0], [[]]
    model = begun = start(first)
    hold = lambda x: min(max(x, BOUNDS[0]), BOUNDS[1])
    for _ in range(rounds):
        by_class = patterns.select("votes", "n", F.posexplode(posteriors(F.col("votes"), model)).alias("c", "q"))
        by_rule = by_class.select("c", (F.col("q") * F.col("n")).alias("w"), F.posexplode("votes").alias("j", "vote"))
        sums = {(r.c, r.j, r.vote): r.w for r in by_rule.groupBy("c", "j", "vote").agg(F.sum("w").alias("w")).collect()}
        total = lambda c: sum(sums.get((c, 0, vote), 0.0) for vote in (-1, 0, 1))  # noqa: B023, E731
        n = sum(total(c) for c in range(first + 1))
        # the starting values weigh as much as one text
        shares = [(total(c) + begun[0][c]) / (n + 1) for c in range(first + 1)]
        chances = []
        for c in range(first + 1):
            votes_of = [(sums.get((c, j, 0), 0.0), sums.get((c, j, 1), 0.0)) for j in range(first)]
            chances.append([hold((bad + begun[1][c][j]) / (bad + good + 1)) for j, (bad, good) in enumerate(votes_of)])
        chances[0] = [min(x, MOST_ON_GOOD) for x in chances[0]]
        moved = max(abs(x - y) for new, old in zip([shares, *chances], [model[0], *model[1]]) for x, y in zip(new, old))
        model = shares, chances
        if moved < SETTLED:
            break
    return model


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, the counts, base_failed, p_good, kept: one row per input row.

    Nulls and empty texts have no words, fail the base rule and are not kept; texts of any length are read whole.
    Texts with equal votes, repeated rows among them, get equal verdicts; an empty table gives no rows. Other columns of `docs` are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality-rules")
    rows = scratch.keep(counts(docs, id_col, text_col).withColumn("votes", F.array(*votes().values())), "counts")
    patterns = scratch.keep(rows.groupBy("votes").agg(F.count("*").alias("n")).coalesce(1), "patterns")
    good = F.coalesce(F.get(posteriors(F.col("votes"), fit(patterns)), F.lit(0)), F.lit(0.0))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), good.alias("p_good"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= least))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op7_quality_rules": op7_quality_rules}
ORACLE_SQL: dict[str, str] = {}
