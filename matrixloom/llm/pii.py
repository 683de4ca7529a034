"""Personal data: fixed patterns, and offset-preserving deobfuscation.

Beside the fixed patterns on the text as it is, transducers rewrite a copy of it: look-alike and
invisible characters, digits that are spelled out, and disguises of @ and dots. Each step keeps, for
every character of the copy, the source span it came from, so identifiers found in the copy map back
to source characters. Texts without anything to rewrite are not copied.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import parts, table

KINDS = ("email", "ip", "card", "phone")

# Fixed patterns. The look-behinds change no match; they keep long runs linear.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Look-alikes of ASCII characters that compatibility normalisation does not give (fixed values).
LOOKALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανρι", "ABEKMHOPCTXaeopcyxijsdhlABEZHIKMNOPTYXoavpi"))
LOOKALIKES |= {"∙": ".", "·": ".", "。": ".", "․": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "＠": "@"}
INVISIBLE = frozenset("\u200b\u200c\u200d\u200e\u200f\u2060\ufeff\u00ad")
# Digit words (fixed values), 0 to 9 in each language; "oh" is a zero between other digit words.
DIGIT_WORDS = {
    w: str(i)
    for line in (
        "zero one two three four five six seven eight nine",
        "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf",
        "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for i, w in enumerate(line.split())
} | {"oh": "0"}
_WORD = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
#: At least seven digit words in a row, with digits among them, "plus" before them allowed.
SPELLED = re.compile(rf"(?:\bplus[\x20,-]+)?(?<![^\W_])(?:(?:{_WORD})(?![^\W_])[\x20,.-]{{0,3}}|[0-9][\x20,.-]{{0,3}}){{7,}}", re.I)
SPELLED_PART = re.compile(rf"\bplus\b|(?<![^\W_])(?:{_WORD})(?![^\W_])|[0-9]", re.I)
#: Figures and digit words side by side, also with dots or dot words between; commas between words only.
MIXED = re.compile(rf"(?:\bplus[\x20-]+)?(?<![^\W_])(?:(?:{_WORD})(?![^\W_])|[0-9]++)(?:(?:\x20+(?:dot|punkt|point|punto)\x20+|\x20?[.-]\x20?|(?<=[^\W\d_]),\x20?(?![0-9])|\x20{{1,3}})(?:(?:{_WORD})(?![^\W_])|[0-9]++))+", re.I)
MIXED_PART = re.compile(rf"\bplus\b|(?<![^\W_])(?:{_WORD})(?![^\W_])|[0-9]+", re.I)

AT = re.compile(r"(?<!\x20)\x20*+(?:[\[({<]\x20*(?:at|ät|arroba|@)\x20*[\])}>]|_at_|-at-)\x20*", re.I)
DOT = re.compile(r"(?<!\x20)\x20*+(?:[\[({<]\x20*(?:dot|punkt|point|punto|\.)\x20*[\])}>]|_dot_|-dot-)\x20*", re.I)
#: user at host dot tld, in plain words: the words between must be a single host each.
PLAIN = re.compile(r"(?<![^\s,;:<(\[])([A-Za-z0-9._%+-]++)\x20+at\x20+([A-Za-z0-9-]+(?:\x20+dot\x20+[A-Za-z0-9-]+)+)(?![\w@])", re.I)
PLAIN_PART = re.compile(r"\x20+(at|dot)\x20+", re.I)
#: Letters that stand for digits, inside a run of digits.
LETTER_DIGIT = re.compile(r"(?<=[0-9])[OolI](?=[\x20-]?[0-9])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of [local]+@[host]+(\\.[host]+)+, found from each @."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > last and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            last = m.end()
            out.append((a, last))
        at = text.find("@", m.end() if m else at + 1)
    return out


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = _digits(m[0])
                if 12 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


class Copy:
    """A rewritten text; character i came from source[starts[i]:ends[i]]."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, list(range(len(text))), list(range(1, len(text) + 1))

    def twin(self) -> Copy:
        other = Copy("")
        other.text, other.starts, other.ends = self.text, self.starts, self.ends  # rewrite replaces them
        return other

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> None:
        """Puts new characters in place of spans; all characters of a replacement map to the whole span."""
        if not pieces:
            return
        text, starts, ends, at = [], [], [], 0
        for a, b, new in pieces:
            text.append(self.text[at:a])
            starts += self.starts[at:a]
            ends += self.ends[at:a]
            text.append(new)
            starts += [self.starts[a]] * len(new)
            ends += [self.ends[b - 1]] * len(new)
            at = b
        text.append(self.text[at:])
        self.text, self.starts, self.ends = "".join(text), starts + self.starts[at:], ends + self.ends[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return self.starts[a], self.ends[b - 1]


def plain_character(c: str) -> str:
    """The ASCII character that c looks like, nothing for invisible ones, else c."""
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    folded = unicodedata.normalize("NFKC", c)
    if len(folded) == 1 and folded.isascii():
        return folded
    value = unicodedata.decimal(c, None)
    return c if value is None else str(value)


@lru_cache(maxsize=1 << 16)
def _changed(c: str) -> bool:
    return plain_character(c) != c


def _strange(text: str) -> list[str]:
    """The characters of the text that look like others or cannot be seen."""
    return [] if text.isascii() else [c for c in set(text) if c > "\x7f" and _changed(c)]


def _look_alikes(copy: Copy, strange: list[str]) -> None:
    found = re.compile("[" + "".join(map(re.escape, strange)) + "]")
    copy.rewrite([(m.start(), m.end(), plain_character(m[0])) for m in found.finditer(copy.text)])


def _disguises(copy: Copy) -> None:
    copy.rewrite([(m.start(), m.end(), "@") for m in AT.finditer(copy.text)])
    copy.rewrite([(m.start(), m.end(), ".") for m in DOT.finditer(copy.text)])
    pieces = []
    for m in PLAIN.finditer(copy.text):
        for p in PLAIN_PART.finditer(copy.text, m.end(1), m.end()):
            pieces.append((p.start(), p.end(), "@" if p[1].lower() == "at" else "."))
    copy.rewrite(pieces)


def _spelled(copy: Copy) -> list[tuple[int, int]]:
    """Rewrites runs of spelled digits; the runs' spans in the new copy."""
    pieces, runs, shift = [], [], 0
    for m in SPELLED.finditer(copy.text):
        parts = list(SPELLED_PART.finditer(copy.text, m.start(), m.end()))
        if sum(not p[0].isdigit() for p in parts) < 7:
            continue
        first = len(pieces)
        end = m.start()
        for p in parts:
            low = p[0].lower()
            pieces.append((max(end, p.start() if len(pieces) == first else end), p.end(), "+" if low == "plus" else DIGIT_WORDS.get(low, p[0])))
            end = p.end()
        a = pieces[first][0] + shift
        shift += len(parts) - (end - pieces[first][0])
        runs.append((a, a + len(parts)))
    copy.rewrite(pieces)
    return runs


def _mixed(copy: Copy) -> None:
    """Rewrites digit words beside figures or other digit words; dots between stay, other gaps beside a word go."""
    pieces = []
    for m in MIXED.finditer(copy.text):
        parts = list(MIXED_PART.finditer(copy.text, m.start(), m.end()))
        if all(p[0].isdigit() for p in parts):
            continue
        last = None
        for p in parts:
            if last:
                gap = copy.text[last.end() : p.start()]
                if gap.strip().isalpha() or "." in gap:
                    pieces.append((last.end(), p.start(), "."))
                elif gap and not (last[0].isdigit() and p[0].isdigit()):
                    pieces.append((last.end(), p.start(), ""))
            if not p[0].isdigit():
                low = p[0].lower()
                pieces.append((p.start(), p.end(), "+" if low == "plus" else DIGIT_WORDS[low]))
            last = p
    copy.rewrite(pieces)


# What opens the gate in front of the rewriting, in text without case; each finds wherever the patterns above find.
_BRACKETS, _BARE = "[({<", ("_at_", "-at-", "_dot_", "-dot-", " dot ")
_LETTERED = re.compile(r"[0-9][OolI][\x20-]?[0-9]")
_UNIT = re.compile(rf"(?<![^\W\d_])(?:{_WORD}|plus)(?![^\W_])")
_NEXT = re.compile(rf"[\x20,.-]*+(?:(?:dot|punkt|point|punto)\x20++)?+(?:[0-9]|(?:{_WORD})(?![^\W_]))")
_BEFORE = re.compile(r"(?:[0-9]|dot|punkt|point|punto)\Z")


def _beside(low: str) -> bool:
    """Whether a digit word or "plus" stands beside a figure or a digit word, with any separators between."""
    for m in _UNIT.finditer(low):
        if _NEXT.match(low, m.end()):
            return True
        before = low[max(0, m.start() - 100) : m.start()]
        if before and (not (rest := before.rstrip(" ,.-")) or _BEFORE.search(rest)):
            return True
    return False


def _rewritable(text: str) -> bool:
    """Whether any rewriting below may find something in a text without strange characters."""
    low = text.casefold()
    return any(x in low for x in _BARE) or _LETTERED.search(text) is not None or _beside(low) or any(x in low for x in _BRACKETS) and (AT.search(text) or DOT.search(text)) is not None


def hidden_spans(text: str, known: list[tuple[int, int, int]], *, gated: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) in source characters of identifiers that only the rewritten copy shows.

    Texts with nothing to rewrite are not copied; without `gated` all are, to the same result.
    """
    strange = _strange(text)
    if gated and not strange and not _rewritable(text):
        return []
    copy = Copy(text)
    if strange:
        _look_alikes(copy, strange)
    _disguises(copy)
    copy.rewrite([(m.start(), m.end(), "0" if m[0] in "Oo" else "1") for m in LETTER_DIGIT.finditer(copy.text)])
    other = copy.twin()
    runs = _spelled(copy)
    found = [(*copy.source(a, b), k) for a, k, b in fixed_spans(copy.text)]
    _mixed(other)
    found += [(*other.source(a, b), k) for a, k, b in fixed_spans(other.text)]
    for a, b in runs:
        digits = _digits(copy.text[a:b])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*copy.source(a, b), 2))
        elif 9 <= len(digits) <= 15:
            found.append((*copy.source(a, b), 3))
    # of spans of one kind the widest, and none inside a known one
    starts, ends = [x for x, _, _ in known], list(accumulate((y for _, _, y in known), max))
    out, reach = [], dict.fromkeys(range(len(KINDS)), -1)
    for a, k, b in sorted({(a, k, b) for a, b, k in found}, key=lambda s: (s[0], -s[2])):
        i = bisect_right(starts, a)
        if b > reach[k] and not (i and ends[i - 1] >= b):
            out.append((a, k, b))
        reach[k] = max(reach[k], b)
    return sorted(out)


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redact(text: str) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first's kind."""
    fixed = fixed_spans(text)
    out, at = [], 0
    for a, k, b in sorted(fixed + hidden_spans(text, fixed), key=lambda s: (s[0], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = b
    return "".join(out) + text[at:] if out else text


def _scan(batches):
    for batch in parts(batches):
        counts, shas, joined = [[] for _ in KINDS], [], []
        for text in batch.column(1).to_pylist():
            fixed = fixed_spans(text or "")
            for k, column in enumerate(counts):
                column.append(sum(s[1] == k for s in fixed))
            shas.append(hashlib.sha256(render(fixed).encode()).hexdigest())
            joined.append(render(fixed + hidden_spans(text, fixed)) if text else "")
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas), pa.array(joined)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the fixed patterns), base_sha256, spans: one row per input row.

    Nulls and empty texts have no spans (the hash of an empty string); texts of any length are read whole, and
    repeated rows one by one. spans holds the fixed patterns' and
    the deobfuscated ones, kind:start:end by start and then kind, in code points, end exclusive; a
    deobfuscated span inside a fixed one is not repeated. Other columns of `docs` are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_texts(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with every span in `text_col` replaced by its kind in brackets; other columns and null texts as they are."""
    at = docs.columns.index(text_col)
    schema = docs.schema

    def run(batches):
        for batch in parts(batches):
            texts = pa.array([None if t is None else redact(t) for t in batch.column(at).to_pylist()], pa.string())
            columns = list(batch.columns)
            columns[at] = texts
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
