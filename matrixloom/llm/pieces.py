"""SentencePiece encoding and decoding by a max-plus parallel scan.

Encoding is a best path through the lattice of pieces. In a unigram model an arc weighs its piece's
score. In a BPE model an arc weighs 0 if the model, given the two pieces' text alone, gives the two
pieces back, and minus infinity if not: a path in which all neighbours are compatible exists once, and is
what merging in order of score gives. So a state is a place and, for BPE, the piece that ends there.

Giant documents are cut into chunks. A chunk's transfer matrix holds, in max-plus arithmetic, the best
weight from each state in which a path can enter it to each in which it can leave it. Matrices of one
document are combined associatively (small ones, never texts; in spans, so that many of one document are
worked on by many tasks), which fixes the states at all boundaries, and every chunk is then traced back on its own. No piece holds a word mark after another character,
so paths of different words are independent, and the different words of a batch go through the lattice
together, each once. Nothing is remembered from batch to batch but which pieces are compatible, in a table
of fixed size.
"""

from __future__ import annotations

import json
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import U64, Scratch, mix, odd_multipliers, parts, table
from ._lattice import LONGEST_WORD, Lattice

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; longer documents are cut.
CHUNK = 1 << 15
#: Matrices that one task multiplies.
SPAN = 64
#: Bytes of texts that a worker encodes at once (some 60 times as much memory).
BATCH_BYTES = 1 << 20
#: Pairs of pieces that the lattice of single words remembers (some 20 MB).
AGREED = 100_000
MARK = "▁"
NO = float("-inf")
#: Below the lowest score, for characters without a piece (as the library has it).
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        elif kind == 2:
            n = number()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + n]
            at += n


_WEIGHTS = odd_multipliers(LONGEST_WORD + 1, 23)


class Model:
    """Pieces, scores and settings of a SentencePiece model file with identity normalisation."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds, trainer, rules = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(float(np.frombuffer(f[2], "<f4")[0]) if 2 in f else 0.0)
                kinds.append(f.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                rules = dict(_fields(value))
        self.bpe = trainer.get(3, 1) == 2
        if trainer.get(3, 1) not in (1, 2) or rules.get(2) or rules.get(4, 1) or not rules.get(5, 1) or 4 in kinds:
            raise ValueError("only unigram and BPE models without normalisation rules and user-defined symbols")
        self.prefix = bool(rules.get(3, 1))
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k in (1, 5)}
        self.bytes = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds)) if k == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = kinds.index(2)
        self.controls = {i for i, k in enumerate(kinds) if k in (2, 3)}
        self.longest = max(map(len, self.ids))
        normal = [s for s, k in zip(self.scores, kinds) if k == 1]
        self.low = min(normal) - UNKNOWN_PENALTY
        #: Whether words (a run of marks, then other characters) can be taken one by one.
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        alone = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))
        self.alone = frozenset(alone)
        self.agree: dict[int, bool] = {}
        #: Lengths, longest first, of the pieces that can end in these four characters.
        self.tails: dict[str, tuple[int, ...]] = {}
        for p in self.ids:
            if len(p) > 3:
                self.tails[p[-4:]] = (*self.tails.get(p[-4:], ()), len(p))
        self.tails = {t: (*sorted(set(n), reverse=True), 3, 2, 1) for t, n in self.tails.items()}
        lattice = Lattice(self.pieces, self.scores, self.ids, self.bytes, self.unknown) if self.bpe and self.by_word else None
        #: For all words of a batch at once; None where the model's merges do not allow it.
        self.lattice = lattice if lattice and lattice.usable else None
        self.raw = [bytes((self.byte_of[i],)) if i in self.byte_of else b"" if i in self.controls else p.replace(MARK, " ").encode() for i, p in enumerate(self.pieces)]

    # --- the lattice -------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by merging: the best-scored neighbours, leftmost first."""
        s = list(text)
        while len(s) > 1:
            best, at = NO, -1
            for i in range(len(s) - 1):
                p = self.ids.get(s[i] + s[i + 1])
                if p is not None and self.scores[p] > best:
                    best, at = self.scores[p], i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def compatible(self, a: str, b: str) -> bool:
        """Whether the model takes a and b side by side; characters without a piece merge with nothing."""
        x, y = self.ids.get(a), self.ids.get(b)
        return x is None or y is None or self.agreed(x << 32 | y)

    def agreed(self, key: int) -> bool:
        got = self.agree.get(key)
        if got is None:
            if len(self.agree) >= AGREED:
                self.agree.clear()
            a, b = self.pieces[key >> 32], self.pieces[key & 0xFFFFFFFF]
            got = self.agree[key] = self.merged(a + b) == [a, b]
        return got

    def weight(self, piece: str) -> float:
        if self.bpe:
            return 0.0
        i = self.ids.get(piece)
        return self.low if i is None else self.scores[i]

    def starts(self, text: str, end: int):
        """Starts of the pieces that end here, longest piece first; single characters are pieces always."""
        for a in range(max(0, end - self.longest), end - 1):
            if text[a:end] in self.ids:
                yield a
        yield end - 1

    def hard(self, text: str, i: int) -> bool:
        """Whether no piece reaches across place i, whatever its neighbours."""
        if i <= 0 or i >= len(text):
            return True
        return text[i - 1] in self.alone or text[i] in self.alone or (self.by_word and text[i] == MARK and text[i - 1] != MARK)

    def paths(self, text: str, begin: int, end: int, entries: list[tuple[int, str]]):
        """Max-plus vectors over `entries` of all states (place, piece before) reached from begin.

        Pieces start in [begin, end) and may end beyond. The piece is "" where it does not matter.
        Returns {place: {piece: (weights, back)}}, back being (place, piece) for each entry.
        """
        n = len(entries)
        at: dict[int, dict[str, tuple]] = {}
        for k, (place, piece) in enumerate(entries):
            w = [NO] * n
            w[k] = 0.0
            at.setdefault(place, {})[piece] = (w, [None] * n)
        bpe = self.bpe
        for i in range(begin, end):
            here = at.get(i)
            if not here:
                continue
            free = bpe and self.hard(text, i)
            for b in range(i + 1, min(i + self.longest, len(text)) + 1):
                piece = text[i:b]
                if b > i + 1 and piece not in self.ids:
                    continue
                add = self.weight(piece)
                best, back = None, None
                for before, (w, _) in here.items():
                    if bpe and not free and before and not self.compatible(before, piece):
                        continue
                    if best is None:
                        best, back = [x + add for x in w], [(i, before) if x > NO else None for x in w]
                    else:
                        for k, x in enumerate(w):
                            if x + add > best[k]:
                                best[k], back[k] = x + add, (i, before)
                if best is None:
                    continue
                key = "" if not bpe or self.hard(text, b) else piece
                there = at.setdefault(b, {})
                old = there.get(key)
                if old is None:
                    there[key] = (best, back)
                else:
                    for k in range(n):
                        if best[k] > old[0][k]:
                            old[0][k], old[1][k] = best[k], back[k]
        return at

    def trace(self, at: dict, place: int, piece: str, begin: int, entry: int) -> list[int]:
        """Ends of the pieces on the best path from the entry to a state."""
        ends = []
        while place > begin:
            back = at[place][piece][1][entry]
            if back is None:
                break
            ends.append(place)
            place, piece = back
        return ends[::-1]

    def piece_ids(self, text: str, begin: int, ends: list[int], out: list[int]) -> None:
        ids, number = self.ids, self.bytes
        for end in ends:
            i = ids.get(text[begin:end])
            if i is not None:
                out.append(i)
            elif number:
                out.extend(number[b] for b in text[begin:end].encode("utf-8", "surrogatepass"))
            else:
                out.append(self.unknown)
            begin = end

    def word(self, word: str) -> list[int]:
        """Pieces of one word; a lattice with one entry, whose states need one value each."""
        if len(word) == 1:
            out: list[int] = []
            self.piece_ids(word, 0, [1], out)
            return out
        if self.bpe:
            return self.merged_ids(word) if word[0] == MARK == word[1] else self.bpe_word(word)
        n, ids, longest = len(word), self.ids, self.longest
        last = [0] * (n + 1)  # start of the piece that ends a best path to each place
        score = [0.0] + [NO] * n
        for b in range(1, n + 1):
            for a in range(max(0, b - longest), b):
                if b - a > 1 and word[a:b] not in ids:
                    continue
                if (s := score[a] + self.weight(word[a:b])) > score[b]:
                    score[b], last[b] = s, a
        ends, b = [], n
        while b:
            ends.append(b)
            b = last[b]
        out = []
        self.piece_ids(word, 0, ends[::-1], out)
        return out

    def bpe_word(self, word: str) -> list[int]:
        """The only path of compatible neighbours; each place is ended by one piece, whatever follows. Runs of marks excepted."""
        n, ids, tails, agree = len(word), self.ids, self.tails, self.agree
        last, at = [0] * (n + 1), [-1] * (n + 1)
        for b in range(1, n + 1):
            for k in tails.get(word[b - 4 : b], (3, 2, 1)) if b > 3 else (3, 2, 1):
                if k > b:
                    continue
                i = ids.get(word[b - k : b], -1)
                if i < 0:
                    if k > 1:
                        continue
                elif k < b and (before := at[b - k]) >= 0:
                    key = before << 32 | i
                    ok = agree.get(key)
                    if not (self.agreed(key) if ok is None else ok):
                        continue
                last[b], at[b] = b - k, i
                break
        out, b = [], n
        while b:
            if at[b] >= 0:
                out.append(at[b])
            elif self.bytes:
                out.extend([self.bytes[c] for c in reversed(word[b - 1].encode("utf-8", "surrogatepass"))])
            else:
                out.append(self.unknown)
            b = last[b]
        out.reverse()
        return out

    def merged_ids(self, word: str) -> list[int]:
        ends, out = np.cumsum([len(s) for s in self.merged(word)]).tolist(), []
        self.piece_ids(word, 0, ends, out)
        return out

    def unit_ids(self, unit: str) -> list[int]:
        return self.word(unit) if len(unit) <= 256 else self.long(unit)

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, end of each text's ids) of marked texts; every different word is encoded once."""
        whole = "".join(texts)
        chars = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        if not len(chars):
            return np.empty(0, np.int32), ends
        start = np.zeros(len(chars) + 1, bool)
        start[0] = start[ends] = True
        if self.by_word:
            mark = chars == ord(MARK)
            alone = np.isin(chars, [ord(c) for c in self.alone])
            start[:-1] |= alone
            start[1:] |= alone
            start[1:-1] |= mark[1:] & ~mark[:-1]
        begin = np.flatnonzero(start[:-1])
        length = np.diff(begin, append=len(chars))
        # different units by a hash of their characters; long ones are not looked for again
        inner = np.minimum(np.arange(len(chars)) - np.repeat(begin, length), LONGEST_WORD)
        names = mix(np.add.reduceat((chars.astype(U64) + U64(1)) * _WEIGHTS[inner], begin))
        short = length <= LONGEST_WORD
        _, first, own = np.unique(names[short], return_index=True, return_inverse=True)
        which = np.empty(len(begin), np.int64)
        which[short] = own
        which[~short] = len(first) + np.arange(len(begin) - len(own))
        example = np.concatenate([np.flatnonzero(short)[first], np.flatnonzero(~short)])
        b, n = begin[example], length[example]
        together = np.zeros(len(b), bool)
        if self.lattice:
            second = chars[np.minimum(b + 1, len(chars) - 1)]
            together = (n <= LONGEST_WORD) & ~((n > 1) & (chars[b] == ord(MARK)) & (second == ord(MARK)))
        pool, counts = self.lattice.words(chars, b[together], n[together]) if together.any() else (np.empty(0, np.int32), np.empty(0, np.int64))
        rest = [self.unit_ids(whole[x : x + y]) for x, y in zip(b[~together].tolist(), n[~together].tolist())]
        size = np.empty(len(b), np.int64)
        size[together], size[~together] = counts, [len(x) for x in rest]
        place = np.empty(len(b), np.int64)
        place[together] = np.cumsum(counts) - counts
        place[~together] = len(pool) + np.cumsum(size[~together]) - size[~together]
        pool = np.concatenate([pool, np.fromiter(chain.from_iterable(rest), np.int32)])
        total = np.concatenate([[0], np.cumsum(size[which])])
        ids = pool[np.arange(total[-1]) + np.repeat(place[which] - total[:-1], size[which])]
        return ids, total[np.searchsorted(begin, ends)]

    def long(self, text: str) -> list[int]:
        out: list[int] = []
        at = self.paths(text, 0, len(text), [(0, "")])
        self.piece_ids(text, 0, self.trace(at, len(text), "", 0, 0), out)
        return out

    # --- texts -------------------------------------------------------------------------------

    def mark(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_many([self.mark(text)])[0].tolist() if text else []

    def decode(self, ids) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text

    # --- chunks of one marked text -----------------------------------------------------------

    def crossing(self, text: str, place: int) -> list[tuple[int, str]]:
        """States in which a path can cross place: pieces that start before it and end at it or beyond."""
        if self.hard(text, place):
            return [(place, "")]
        out = set()
        for a in range(max(0, place - self.longest), place):
            for b in range(place, min(a + self.longest, len(text)) + 1):
                if b == a + 1 or text[a:b] in self.ids:
                    out.add((b, "" if not self.bpe or self.hard(text, b) else text[a:b]))
        return sorted(out)


class Chunk:
    """Part [begin, end) of a marked text, with enough context on both sides; places count from the context's start."""

    def __init__(self, model: Model, text: str, begin: int, end: int):
        self.model, self.text, self.begin, self.end = model, text, begin, end
        self.entries, self.exits = model.crossing(text, begin), model.crossing(text, end)
        bounds = [i for i in (self._bound(range(begin, end)), self._bound(range(end, begin, -1))) if i is not None]
        #: First and last place in the chunk that no piece crosses; everything between is encoded word by word.
        self.inner = (bounds[0], bounds[1]) if len(bounds) == 2 and bounds[0] < bounds[1] else None

    def _bound(self, places):
        return next((i for i in places if self.model.hard(self.text, i)), None)

    def matrix(self) -> list[list[float]]:
        """Max-plus transfer matrix: best weight from each entry to each exit."""
        m = self.model
        if not self.inner:
            return self._part(self.begin, self.end, self.entries, self.exits)
        first, last = self.inner
        head = self._part(self.begin, first, self.entries, [(first, "")])
        tail = self._part(last, self.end, [(last, "")], self.exits)
        middle = 0.0
        if not m.bpe:  # the same constant for all paths; kept so that matrices are true weights
            at = m.paths(self.text, first, last, [(first, "")])
            middle = at[last][""][0][0]
        return product(product(head, [[middle]]), tail)

    def _part(self, begin, end, entries, exits):
        if begin == end:
            return [[0.0 if a == b else NO for b in exits] for a in entries]
        at = self.model.paths(self.text, begin, end, entries)
        return [[at[p][q][0][k] if p in at and q in at[p] else NO for p, q in exits] for k in range(len(entries))]

    def traced(self, entry: int, leave: int) -> tuple[list[int], str, list[int]]:
        """Pieces that start in the chunk on the best path from an entry to an exit: at its head, the text between, at its tail."""
        head, tail = [], []
        start, finish = self.entries[entry], self.exits[leave]
        if not self.inner:
            self._trace(self.begin, self.end, start, finish, head)
            return head, "", tail
        first, last = self.inner
        self._trace(self.begin, first, start, (first, ""), head)
        self._trace(last, self.end, (last, ""), finish, tail)
        return head, self.text[first:last], tail

    def ids(self, entry: int, leave: int) -> list[int]:
        head, text, tail = self.traced(entry, leave)
        return head + self.model.encode_many([text])[0].tolist() + tail

    def _trace(self, begin, end, start, finish, out) -> None:
        if start == finish:
            return
        at = self.model.paths(self.text, begin, end, [start])
        self.model.piece_ids(self.text, start[0], self.model.trace(at, *finish, start[0], 0), out)


def product(a: list[list[float]], b: list[list[float]]) -> list[list[float]]:
    """Max-plus product of matrices; associative."""
    return [[max((x + b[k][j] for k, x in enumerate(row) if x > NO), default=NO) for j in range(len(b[0]))] for row in a]


def boundary_states(matrices: list[list[list[float]]], entry: int | None = None, leave: int | None = None) -> list[tuple[int, int]]:
    """(entry, exit) of each matrix on the best path, from products of the matrices before and after each boundary.

    The path begins and ends in the states that are given, or in the best ones.
    """
    ends = [None] * len(matrices)
    # best weight from each state before a matrix to the end
    after = [0.0 if leave in (None, j) else NO for j in range(len(matrices[-1][0]))]
    right = [after]
    for m in reversed(matrices):
        right.append([max((x + y for x, y in zip(row, right[-1])), default=NO) for row in m])
    right.reverse()
    state = max(range(len(right[0])), key=right[0].__getitem__) if entry is None else entry
    for i, m in enumerate(matrices):
        out = max(range(len(m[state])), key=lambda j: m[state][j] + right[i + 1][j])
        ends[i] = (state, out)
        state = out
    return ends


def cut(model: Model, text: str, size: int) -> list[tuple[str, int, int]]:
    """(text with context, begin, end) of the chunks of a marked text."""
    side = model.longest + 1
    out = []
    for a in range(0, len(text), size):
        b = min(a + size, len(text))
        lo, hi = max(0, a - side), min(len(text), b + side)
        out.append((text[lo:hi], a - lo, b - lo))
    return out


# --- Spark -----------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _model(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def _same(model: Model, text: str | None, ids: list[int]) -> bool:
    return model.decode(ids) == (text or "").replace(MARK, " ")


def _short(path: str):
    def run(batches):
        model = _model(path)
        for part in parts(batches, BATCH_BYTES):
            texts = [t or "" for t in part.column(1).to_pylist()]
            ids, ends = model.encode_many([model.mark(t) for t in texts])
            begins, flat = np.concatenate([[0], ends[:-1]]), ids.tolist()
            same = [_same(model, t, flat[a:b]) for t, a, b in zip(texts, begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ends - begins, pa.int64()), _lists(ids, ends), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "same_text"])

    return run


def _chunks(path: str, chunk: int):
    def run(batches):
        model = _model(path)
        for batch in parts(batches):
            for rid, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                cuts = cut(model, model.mark(text), chunk)
                n = len(cuts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([rid] * n), pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int32()), *(pa.array(v, t) for v, t in zip(zip(*cuts), (pa.string(), pa.int32(), pa.int32())))], names=["rid", "doc_id", "part", "text", "begin", "end"]
                )

    return run


def _matrices(path: str):
    def run(batches):
        model = _model(path)
        for batch in parts(batches):
            rows = [json.dumps(Chunk(model, *row).matrix()) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "begin", "end")))]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("part"), pa.array(rows, pa.string())], names=["rid", "part", "matrix"])

    return run


def _of(table_: pa.Table) -> list[list[list[float]]]:
    return [json.loads(m) for m in table_["matrix"].to_pylist()]


def _spans(table_: pa.Table) -> pa.Table:
    """The product of a span's matrices."""
    whole = reduce(product, _of(table_.sort_by("part")))
    return pa.table({"rid": table_["rid"][:1], "part": table_["span"][:1], "matrix": pa.array([json.dumps(whole)], pa.string())})


def _states(table_: pa.Table) -> pa.Table:
    """States at the boundaries of a document's matrices, or of a span's between its own entry and exit."""
    t = table_.sort_by("part")
    given = [t[c][0].as_py() for c in ("entry", "leave")] if "entry" in t.column_names else []
    states = boundary_states(_of(t), *given)
    return pa.table({"rid": t["rid"], "part": t["part"], "entry": pa.array([a for a, _ in states], pa.int32()), "leave": pa.array([b for _, b in states], pa.int32())})


def _scanned(matrices: DataFrame, longest: int) -> DataFrame:
    """(rid, part, entry, leave) of all matrices (rid, part, matrix): a parallel scan where a document has many.

    Spans of SPAN matrices are multiplied, each in a task of its own; their products, spanned again while there are many,
    give the states between spans; then each span's own states follow, again in tasks of their own.
    """
    kind = "rid long, part int, entry int, leave int"
    if longest <= SPAN:
        return matrices.groupBy("rid").applyInArrow(_states, kind)
    spanned = matrices.withColumn("span", F.expr(f"cast(part div {SPAN} as int)"))
    products = spanned.groupBy("rid", "span").applyInArrow(_spans, "rid long, part int, matrix string")
    between = _scanned(products, -(-longest // SPAN)).withColumnRenamed("part", "span")
    return spanned.join(between, ["rid", "span"]).groupBy("rid", "span").applyInArrow(_states, kind)


def _traced(path: str):
    def run(batches):
        model = _model(path)
        for part in parts(batches, BATCH_BYTES):
            rows = zip(*(part.column(c).to_pylist() for c in ("text", "begin", "end", "entry", "leave")))
            heads, middles, tails = zip(*(Chunk(model, text, begin, end).traced(entry, leave) for text, begin, end, entry, leave in rows))
            ids, ends = model.encode_many(list(middles))
            between = np.split(ids, ends[:-1])
            lists = [np.concatenate([np.array(h, np.int32), m, np.array(t, np.int32)]) for h, m, t in zip(heads, between, tails)]
            yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), part.column("part"), _lists(np.concatenate(lists), np.cumsum([len(x) for x in lists]))], names=["rid", "doc_id", "part", "ids"])

    return run


def _join(path: str):
    def run(batches):
        model = _model(path)
        for batch in parts(batches):
            lists, same = [], []
            for cuts, text in zip(batch.column("parts").to_pylist(), batch.column("text").to_pylist()):
                ids = [i for p in sorted(cuts, key=lambda p: p["part"]) for i in p["ids"]]
                lists.append(ids)
                same.append(_same(model, text, ids))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in lists], pa.int64()), _lists(np.array([i for x in lists for i in x], np.int32), np.cumsum([len(x) for x in lists])), pa.array(same, pa.bool_())], names=["doc_id", "n_pieces", "ids", "same_text"])

    return run


SCHEMA = "doc_id long, n_pieces long, ids array<int>, same_text boolean"


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_pieces, ids, same_text: one row per input row.

    same_text tells that decoding the ids gives the text back (word marks in a text come back as spaces).
    Nulls and empty texts have no pieces; texts of any length are encoded whole. Repeated rows are encoded one by one. Other columns are ignored.
    The model file must be at the same path on every executor.
    """
    scratch = Scratch(docs.sparkSession, "pieces")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    giant = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = base.where(~giant).mapInArrow(_short(model), SCHEMA)
    long = scratch.keep(base.where(giant).withColumn("rid", F.monotonically_increasing_id()).select("rid", "doc_id", "text"), "long")
    chunks = long.repartition("rid").mapInArrow(_chunks(model, chunk), "rid long, doc_id long, part int, text string, begin int, end int")
    chunks = scratch.keep(chunks.repartition("rid", "part"), "chunks")
    matrices = chunks.mapInArrow(_matrices(model), "rid long, part int, matrix string")
    longest = (chunks.agg(F.max("part")).first()[0] or 0) + 1
    if longest > SPAN:
        matrices = scratch.keep(matrices, "matrices")
    traced = chunks.join(_scanned(matrices, longest), ["rid", "part"]).mapInArrow(_traced(model), "rid long, doc_id long, part int, ids array<int>")
    whole = traced.groupBy("rid", "doc_id").agg(F.collect_list(F.struct("part", "ids")).alias("parts")).join(long.select("rid", "text"), "rid").mapInArrow(_join(model), SCHEMA)
    return short.unionByName(whole)


def decode(encoded: DataFrame, *, ids_col: str = "ids", out_col: str = "decoded", model: str = MODEL) -> DataFrame:
    """The input with a column of decoded texts added; null for null ids."""
    at = encoded.columns.index(ids_col)
    schema = encoded.withColumn(out_col, F.lit("")).schema

    def run(batches):
        m = _model(model)
        for batch in batches:
            texts = [None if ids is None else m.decode(ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[f.name for f in schema])

    return encoded.mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
ORACLE_SQL: dict[str, str] = {}
