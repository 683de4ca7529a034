import hashlib
import random
import re
from collections import Counter

from matrixloom.llm import substring_dedup as S

from .oracle import SF, same

SCHEMA = "doc_id long, text string"


def brute(rows):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())


def test_documents_match_sql(spark):
    assert same(S.op2_substring_dedup(spark, SF), S.ORACLE_SQL["op2_substring_dedup"]) == 1000


def corpus():
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(60)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    passage, rows = text(60), []
    for i in range(80):
        a, b = sorted((rng.randint(0, 60), rng.randint(0, 60)))
        rows.append((i, " ".join(text(rng.randint(0, 50)) + passage[a:b] + text(rng.randint(0, 50)))))
    rows += [(100, "same " * 200), (101, "ab cd " * 60), (102, "ab cd " * 17), (103, " ".join(passage)), (103, " ".join(passage)), (104, " ".join(text(50))), (104, " ".join(passage[5:45]))]
    rows += [(105, " ".join(passage[:35])), (106, " ".join(passage[:34])), (107, None), (108, ""), (109, " \n "), (110, " ".join(text(9000) + passage + text(9000)))]
    return rows


def test_small_cases(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, b"x", 1) for d, t in rows], "doc_id long, text string, digest binary, n_words int")
    assert result(S.substring_dedup(df)) == brute(rows)
    assert S.substring_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_crowded_prefixes(spark, monkeypatch):
    monkeypatch.setattr(S, "GROUP_BLOCKS", 3)
    rows = corpus()
    assert result(S.substring_dedup(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_rows_without_an_id(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"u{rng.randrange(500)}" for _ in range(n))
    passage, alone = text(50), text(70)
    rows = [(7, f"{text(20)} {passage}"), (None, f"{passage} {text(9)}"), (None, alone), (None, alone), (9, f"{passage} {text(30)}"), (None, None), (None, text(80))]
    got = [(r[0] or -1, *r[1:]) for r in S.substring_dedup(spark.createDataFrame(rows, SCHEMA)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got) == brute([(d or -1, t) for d, t in rows])
