import random
import re
from collections import Counter

from matrixloom.llm import quality_rules as Q


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def check(rows, out):
    want = {d: brute(t) for d, t in rows}
    got = out.collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id], r.doc_id
        assert not (r.base_failed and r.kept)


def test_documents_and_agreement_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = Q.quality_rules(docs)
    check([(r.doc_id, r.text) for r in docs.collect()], out)
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    rows = [(labels[r.doc_id], r.kept, r.base_failed) for r in out.collect() if r.doc_id in labels]
    bad = [k for q, k, _ in rows if q == 0]
    good = [k for q, k, failed in rows if q == 1 and not failed]
    assert sum(bad) <= 0.03 * len(bad) and sum(good) >= 0.99 * len(good)


def test_cases(spark):
    rng = random.Random(2)
    vocab = ["a", "É", "x#", "THE", "cat.", "\x1c", "\xa0b"]
    rows = [None, "", " \n\t\r\x0b\x0c", "one two three four five", "a b c d e a b c d e", "x " * 30000, "l\nl\nl\n\n \n \n", "😀 <b>|$", "a\x85b c d"]
    rows += ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "  ", "\t"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    rows = [(i % 85, t) if i < 85 else (i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame([(i, t, 7, "u") for i, t in rows], "doc_id long, text string, n_words int, w string")
    check(rows, Q.quality_rules(df))
    assert Q.quality_rules(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_shares_and_accuracies(spark):
    """Votes drawn from a known model: EM finds it."""
    rng = random.Random(6)
    shares, chances = [0.75, 0.15, 0.0, 0.1], [[0.02, 0.01, 0.03], [0.9, 0.2, 0.1], [0.1, 0.9, 0.1], [0.05, 0.3, 0.95]]
    rows = []
    for _ in range(20000):
        c = rng.choices(range(4), shares)[0]
        rows.append(([-1 if rng.random() < 0.1 else int(rng.random() >= p) for p in chances[c]],))
    df = spark.createDataFrame(rows, "votes array<int>").groupBy("votes").count().withColumnRenamed("count", "n").cache()
    got = Q.fit(df, rounds=60)
    assert abs(got[0][0] - 0.75) < 0.05 and abs(got[0][1] - 0.15) < 0.05 and abs(got[0][3] - 0.1) < 0.05
    assert abs(got[1][1][0] - 0.9) < 0.1 and abs(got[1][3][2] - 0.95) < 0.1 and max(got[1][0]) < 0.06


def test_runs_no_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = Q.counts(docs, "doc_id", "text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
