"""The lattice of a BPE model for many words at once, in numpy arrays.

Each place of a word is ended by one piece, whatever follows: the one that is compatible with the piece
that ends where it starts. So the max-plus vector of a place has one finite entry, and all words advance
by one place a step. Two pieces are compatible unless some symbol on the right edge of the first one's
merges and some symbol on the left edge of the second one's are merged while both are there.
"""

from __future__ import annotations

import numpy as np

from ._common import MIX1, U64

#: Longer words go through the lattice one by one.
LONGEST_WORD = 64
#: Characters of different words that are worked on together (some 150 bytes each).
PART = 400_000
#: log2 of the slots that remember pairs of pieces (8 bytes each; a new pair replaces the slot's old one).
PAIR_BITS = 21

BASE = U64(0x9E3779B97F4A7C15)


class Table:
    """Values of distinct non-zero 64-bit keys, by open addressing with few keys a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys)).bit_length() + 1)
        self.shift, self.last = U64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, U64), np.full(1 << bits, -1, values.dtype)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at[todo]] == 0
            self.keys[at[todo[free]]] = keys[todo[free]]  # of several, one stays
            self.values[at[todo[free]]] = values[todo[free]]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & self.last
        slots = self._find(keys)
        self.values[slots] = values

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX1) >> self.shift).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, or an empty one."""
        at = self._slot(keys)
        got = self.keys[at]
        todo = np.flatnonzero((got != keys) & (got != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.last
            got = self.keys[at[todo]]
            todo = todo[(got != keys[todo]) & (got != 0)]
        return at

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values; -1 for unknown keys."""
        return self.values[self._find(keys)]


class Lattice:
    def __init__(self, pieces: list[str], scores: list[float], ids: dict[str, int], byte_ids: dict[int, int], unknown: int):
        self.longest = max(map(len, ids))
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        long = [p for p in ids if len(p) > 1]
        hashes = np.zeros(len(long), U64)
        for k in range(self.longest):
            own = np.array([i for i, p in enumerate(long) if len(p) > k], np.int64)
            hashes[own] = hashes[own] * BASE + U64(1) + np.array([ord(long[i][k]) for i in own], U64)
        self.of_hash = Table(hashes, np.array([ids[p] for p in long], np.int32))
        if len(np.unique(hashes)) < len(hashes) or (hashes == 0).any():
            raise ValueError("pieces with equal hashes")
        self.byte = np.array([byte_ids.get(b, unknown) for b in range(256)], np.int32)
        self.with_bytes, self.unknown = bool(byte_ids), unknown
        self._edges(pieces, scores, ids)
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)

    def _edges(self, pieces, scores, ids) -> None:
        """For each piece, the symbols at its left and right edge while it is merged, with the times they come and go.

        A time is the score of the merge that happens then; times fall. usable tells whether they do in all pieces.
        """
        inf = float("inf")
        self.usable = True
        edges = ([[] for _ in pieces], [[] for _ in pieces])
        for piece, own in ids.items():
            s, low = [(ids.get(c), c, inf) for c in piece], inf
            left, right = ([], [])
            while len(s) > 1:
                best, at = -inf, -1
                for i in range(len(s) - 1):
                    p = ids.get(s[i][1] + s[i + 1][1])
                    if p is not None and scores[p] > best:
                        best, at = scores[p], i
                if at < 0:
                    break
                if at == 0:
                    left.append((s[0][0], s[0][2], best))
                if at == len(s) - 2:
                    right.append((s[-1][0], s[-1][2], best))
                text = s[at][1] + s[at + 1][1]
                s[at : at + 2] = [(ids[text], text, best)]
                self.usable &= best <= low
                low = best
            self.usable &= len(s) == 1 and all(c in ids for c in piece)
            for side, found, symbol in ((edges[0], left, s[0]), (edges[1], right, s[-1])):
                side[own] = [*found, (symbol[0], symbol[2], -inf)]
        if not self.usable:
            return
        # [piece, step]: symbol (-1 beyond the last), when it comes, when it goes
        self.edge = []
        for side in edges:
            depth = max(map(len, side))
            self.edge.append(tuple(np.array([[e[j] for e in x] + [fill] * (depth - len(x)) for x in side], t) for j, fill, t in ((0, -1, np.int32), (1, 0.0, np.float32), (2, inf, np.float32))))
        joined = [(ids[p[:j]], ids[p[j:]], scores[i]) for p, i in ids.items() for j in range(1, len(p)) if p[:j] in ids and p[j:] in ids]
        self.score_of = Table(np.array([a + 1 << 32 | b for a, b, _ in joined], U64), np.arange(len(joined), dtype=np.int32))
        self.joined_scores = np.array([x for *_, x in joined], np.float32)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the model takes pieces a and b side by side; from the pieces' edges."""
        ok = np.ones(len(a), bool)
        (l_id, l_from, l_to), (r_id, r_from, r_to) = self.edge
        for i in range(r_id.shape[1]):
            for j in range(l_id.shape[1]):
                rows = np.flatnonzero(ok & (r_id[a, i] >= 0) & (l_id[b, j] >= 0))
                if not len(rows):
                    break
                x, y = a[rows], b[rows]
                at = self.score_of((r_id[x, i].astype(np.int64) + 1 << 32 | l_id[y, j]).astype(U64))
                rows, x, y, at = rows[at >= 0], x[at >= 0], y[at >= 0], at[at >= 0]
                when = np.minimum(self.joined_scores[at], np.minimum(r_from[x, i], l_from[y, j]))
                # of equal merges the leftmost comes first
                ok[rows[(when > r_to[x, i]) & (when >= l_to[y, j])]] = False
        return ok

    def agreed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible(a, b), remembered."""
        key = a.astype(np.int64) << 32 | b
        at = ((key.view(U64) * MIX1) >> U64(64 - PAIR_BITS)).astype(np.int64)
        got = self.pairs[at]
        out = (got & 1).astype(bool)
        new = np.flatnonzero(got >> 1 != key)
        if len(new):
            keys, back = np.unique(key[new], return_inverse=True)
            ok = self.compatible(keys >> 32, keys & 0xFFFFFFFF)
            out[new] = ok[back]
            self.pairs[at[new]] = key[new] << 1 | out[new]
        return out

    def _pieces_at(self, chars: np.ndarray, inner: np.ndarray) -> list[np.ndarray]:
        """For each length, the piece of so many characters that ends at each place, or -1; inner: places before in the word."""
        out = [self.char[chars]]
        values = chars.astype(U64) + U64(1)
        h, live = values, np.arange(len(chars))
        for k in range(1, self.longest):
            live = live[inner[live] >= k]
            nxt = np.zeros(len(chars), U64)
            # the hash of k + 1 characters from that of the last k: the first one weighs most
            nxt[live] = values[live - k] * U64(pow(int(BASE), k, 1 << 64)) + h[live]
            found = np.full(len(chars), -1, np.int32)
            found[live] = self.of_hash(nxt[live])
            out.append(found)
            h = nxt
        return out

    def words(self, chars: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of the words chars[begin:begin + length], without double marks, LONGEST_WORD at most."""
        flats, counts = [], []
        cut = np.flatnonzero(np.diff(np.cumsum(length) // PART)) + 1
        for b, n in zip(np.split(begin, cut), np.split(length, cut)):
            if len(b):
                flat, count = self._part(chars, b, n)
                flats.append(flat)
                counts.append(count)
        return (np.concatenate(flats), np.concatenate(counts)) if flats else (np.empty(0, np.int32), np.empty(0, np.int64))

    def _part(self, chars, begin, length):
        order = np.argsort(-length, kind="stable")
        n = length[order]
        start = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(start, n)
        own = chars[np.repeat(begin[order], n) + inner]
        piece = self._pieces_at(own, inner)
        ends, last = np.full(len(own), -1, np.int32), np.ones(len(own), np.int8)
        active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # words that reach each place
        for b in range(1, n[0] + 1):
            place = start[: active[b - 1]] + b - 1
            for k in range(min(b, self.longest), 0, -1):
                found = piece[k - 1][place]
                hit = np.flatnonzero(found >= 0)
                if len(hit) and k < b:
                    before = ends[place[hit] - k]
                    ask = np.flatnonzero(before >= 0)
                    hit = np.delete(hit, ask[~self.agreed(before[ask], found[hit[ask]])])
                ends[place[hit]], last[place[hit]] = found[hit], k
                place = np.delete(place, hit)
                if not len(place):
                    break
        # back from the words' ends, all at once
        word, left = np.arange(len(n)), n.copy()
        steps, places = [], []
        while len(word):
            at = start[word] + left[word] - 1
            steps.append(word)
            places.append(at)
            left[word] -= last[at]
            word = word[left[word] > 0]
        word, at = np.concatenate(steps), np.concatenate(places)
        step = np.repeat(np.arange(len(steps)), list(map(len, steps)))
        count = np.bincount(word, minlength=len(n))
        # rows in the order of the input, pieces from left to right
        given = np.empty(len(n), np.int64)
        given[order] = count
        first = (np.cumsum(given) - given)[order]
        to = first[word] + count[word] - 1 - step
        flat, source = np.empty(len(to), np.int32), np.empty(len(to), np.int64)
        flat[to], source[to] = ends[at], at
        if (flat < 0).any():
            flat, given = self._unknown(flat, own[source], given)
        return flat, given

    def _unknown(self, flat, chars, count):
        """Bytes, or the unknown piece, in place of characters without a piece."""
        if not self.with_bytes:
            return np.where(flat < 0, self.unknown, flat).astype(np.int32), count
        size = np.where(flat < 0, 1 + (chars > 0x7F) + (chars > 0x7FF) + (chars > 0xFFFF), 1)
        row = np.repeat(np.arange(len(flat)), size)
        j = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        c, n = chars[row].astype(np.int64), size[row]
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
        byte = np.where(j == 0, lead | c >> 6 * (n - 1), 0x80 | (c >> 6 * (n - 1 - j)) & 0x3F)
        out = np.where(flat[row] < 0, self.byte[byte & 0xFF], flat[row]).astype(np.int32)
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])]
        return out, np.diff(ends)
