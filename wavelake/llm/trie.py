"""N-gram tries in Elias-Fano form: levels of word numbers, pointers between them, and quantised probabilities.

Everything lies in one buffer of flat arrays that are read in place, be it bytes or a mapped file. Level 1 and the
pointers are monotone; the words of a lower level are made so by putting the rank of the context above the number of
the word, so a word is sought among its context's successors only. All look-ups are vectorised.
"""

from __future__ import annotations

import numpy as np

from .common import U64

#: A share's code is 1 - log10 in these steps; 0 is a share of nothing.
STEP = 1 / 1024
MAX_CODE = 65535


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of shares from 0 to 1, as 16-bit numbers."""
    seen = p > 0
    code = np.rint(-np.log10(np.where(seen, p, 1.0)) / STEP) + 1
    return np.where(seen, np.minimum(code, MAX_CODE), 0).astype(np.uint16)


def share_of(codes: np.ndarray) -> np.ndarray:
    return np.where(codes > 0, 10.0 ** ((1.0 - codes.astype(np.float64)) * STEP), 0.0)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of each value, end to end in 64-bit words, and a word of padding."""
    n = len(values)
    out = np.zeros(n * width // 64 + 2, U64)
    if n and width:
        at = np.arange(n, dtype=np.int64) * width
        word, shift = at >> 6, (at & 63).astype(U64)
        np.bitwise_or.at(out, word, values << shift)
        spill = (at & 63) + width > 64
        np.bitwise_or.at(out, word[spill] + 1, values[spill] >> (U64(64) - shift[spill]))
    return out


def _unpack(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), U64)
    at = i * width
    word, shift = at >> 6, (at & 63).astype(U64)
    high = np.where(shift > 0, words[word + 1] << ((U64(64) - shift) & U64(63)), U64(0))
    return ((words[word] >> shift) | high) & U64((1 << width) - 1)


def _select_in_word(x: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Position of the rank-th (from 0) set bit of each word, by halving."""
    at = np.zeros(len(x), np.int64)
    for width in (32, 16, 8, 4, 2, 1):
        low = np.bitwise_count(x & U64((1 << width) - 1)).astype(np.int64)
        up = rank >= low
        rank = np.where(up, rank - low, rank)
        x = np.where(up, x >> U64(width), x)
        at += up * width
    return at


class EliasFano:
    """A non-decreasing sequence of integers below 2**63, in about 2 + log2(universe / n) bits each.

    arrays: lower bits packed; upper bits in unary, a set bit for each value; ones before each word of the latter.
    """

    def __init__(self, n: int, width: int, lower: np.ndarray, upper: np.ndarray, ones: np.ndarray) -> None:
        self.n, self.width, self.lower, self.upper, self.ones = n, width, lower, upper, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        values = values.astype(U64)
        width = max(0, int(values[-1] // U64(n)).bit_length() - 1) if n else 0
        place = (values >> U64(width)).astype(np.int64) + np.arange(n)
        upper = np.zeros((int(place[-1]) + 1 >> 6) + 1 if n else 1, U64)  # a zero follows the last one
        np.bitwise_or.at(upper, place >> 6, U64(1) << (place & 63).astype(U64))
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)[:-1]]).astype(np.uint32)
        return cls(n, width, _pack(values & U64((1 << width) - 1), width), upper, ones)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.ones, i.astype(np.uint32), side="right") - 1
        place = (word << 6) + _select_in_word(self.upper[word], i - self.ones[word].astype(np.int64))
        return ((place - i).astype(U64) << U64(self.width)) | _unpack(self.lower, self.width, i)

    def _ones_before_zero(self, k: np.ndarray) -> np.ndarray:
        """How many values have an upper part of at most k: the ones before the k-th zero (from 0) of the unary part."""
        zeros = (np.arange(len(self.ones), dtype=np.int64) << 6) - self.ones
        word = np.searchsorted(zeros, k, side="right") - 1
        return (word << 6) + _select_in_word(~self.upper[word], k - zeros[word]) - k

    def successor(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each x the first place in [low, high) whose value is at least x, or high.

        The unary part tells which places share x's upper bits; those few are searched by halving.
        """
        if not self.n:
            return high.copy()
        part = np.minimum(x >> U64(self.width), self._top()).astype(np.int64)
        after = self._ones_before_zero(part)
        before = np.where(part > 0, self._ones_before_zero(np.maximum(part - 1, 0)), 0)
        beyond = (x >> U64(self.width)) > self._top()
        low = np.clip(np.where(beyond, self.n, before), low, high)
        high = np.clip(np.where(beyond, self.n, after), low, high)
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            less = self[middle] < x[live]
            low[live] = np.where(less, middle + 1, low[live])
            high[live] = np.where(less, high[live], middle)
            live = live[low[live] < high[live]]
        return low

    def _top(self) -> np.uint64:
        """The largest upper part: there is a zero in the unary part for each one up to it."""
        return U64((len(self.upper) << 6) - self.n - 1)


class Coded:
    """Codes of which few differ. The most frequent one is told once. A bit for each code tells where the others are,
    numbers how many of them lie before each word of bits; their codes are places in a table of the different ones, packed."""

    def __init__(self, usual: int, marks: np.ndarray, before: np.ndarray, table: np.ndarray, places: np.ndarray) -> None:
        self.usual, self.marks, self.before, self.table, self.places = usual, marks, before, table, places
        self.width = max(0, len(table) - 1).bit_length()

    @classmethod
    def of(cls, codes: np.ndarray) -> Coded:
        usual = int(np.argmax(np.bincount(codes))) if len(codes) else 0
        other = codes != usual
        table, places = np.unique(codes[other], return_inverse=True)
        marks = np.packbits(np.concatenate([other, np.zeros(-len(codes) % 64, bool)]), bitorder="little").view(U64)
        before = (np.cumsum(np.bitwise_count(marks), dtype=np.int64) - np.bitwise_count(marks)).astype(np.uint32)
        return cls(usual, marks, before, table, _pack(places.astype(U64), max(0, len(table) - 1).bit_length()))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        out = np.full(len(i), self.usual, np.uint16)
        if len(self.table) and len(i):
            word, bit = self.marks[i >> 6], (i & 63).astype(U64)
            hit = np.flatnonzero(word >> bit & U64(1))
            below = np.bitwise_count(word[hit] & ((U64(1) << bit[hit]) - U64(1)))
            at = self.before[i[hit] >> 6].astype(np.int64) + below
            out[hit] = self.table[_unpack(self.places, self.width, at).astype(np.int64)]
        return out


class Buffer:
    """Takes arrays one after the other out of a buffer that joined() made; nothing is copied."""

    def __init__(self, buffer: object) -> None:
        self.buffer, self.at = buffer, 0

    def take(self, kind: type, n: int) -> np.ndarray:
        a = np.frombuffer(self.buffer, kind, n, self.at)
        self.at += a.nbytes + -a.nbytes % 8
        return a


def joined(arrays: list[np.ndarray]) -> bytes:
    """Arrays end to end, each from a multiple of 8 bytes on."""
    return b"".join(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays)


class Trie:
    """vocabulary: the words of the levels below the first, whose places there stand for them; levels: the words of each
    level, from the second on below their contexts' ranks; pointers: of each level but the last, where each node's
    successors begin, and the end; codes: of each level from the second on; counts: a number for each word of level 1."""

    def __init__(self, vocabulary: EliasFano, levels: list[EliasFano], pointers: list[EliasFano], codes: list[Coded], counts: np.ndarray) -> None:
        self.vocabulary, self.levels, self.pointers, self.codes, self.counts = vocabulary, levels, pointers, codes, counts
        self.bits = max(0, vocabulary.n - 1).bit_length()

    @classmethod
    def of(cls, first: np.ndarray, counts: np.ndarray, grams: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Trie:
        """first: words of level 1 in order, and their counts; grams: for each further level (place of the context in the level above, word, code), in order."""
        levels, pointers, codes = [EliasFano.of(first)], [], []
        size = len(first)
        vocabulary = np.unique(np.concatenate([np.empty(0, np.int64), *[word for _, word, _ in grams]])).astype(np.int64)
        bits = max(0, len(vocabulary) - 1).bit_length()
        for context, word, code in grams:
            word = np.searchsorted(vocabulary, word)
            if size and (size - 1).bit_length() + bits > 63:
                raise ValueError("too many contexts for one trie: use more shards")
            pointers.append(EliasFano.of(np.searchsorted(context, np.arange(size + 1))))
            levels.append(EliasFano.of((context.astype(U64) << U64(bits)) | word.astype(U64)))
            codes.append(Coded.of(code))
            size = len(word)
        return cls(EliasFano.of(vocabulary), levels, pointers, codes, counts.astype(U64))

    def named(self, word: np.ndarray) -> np.ndarray:
        """What stands for words below level 1; -1 for those that are nowhere there."""
        v, (asked, at) = self.vocabulary, np.unique(word.astype(U64), return_inverse=True)
        end = np.full(len(asked), v.n)
        return self._hit(v, v.successor(asked, np.zeros(len(asked), np.int64), end), asked, end)[at]

    def root(self, word: np.ndarray) -> np.ndarray:
        """Places of words in level 1, or -1."""
        level = self.levels[0]
        at = level.successor(word.astype(U64), np.zeros(len(word), np.int64), np.full(len(word), level.n))
        return self._hit(level, at, word.astype(U64), np.full(len(word), level.n))

    def below(self, level: int, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Places in ``level`` (from 1 on) of words (as named) among the successors of their contexts, which are places in the level above or -1; -1 if there is none."""
        out = np.full(len(word), -1, np.int64)
        known = np.flatnonzero((context >= 0) & (word >= 0))
        if len(known):
            c = context[known]
            low, high = self.pointers[level - 1][c].astype(np.int64), self.pointers[level - 1][c + 1].astype(np.int64)
            key = (c.astype(U64) << U64(self.bits)) | word[known].astype(U64)
            out[known] = self._hit(self.levels[level], self.levels[level].successor(key, low, high), key, high)
        return out

    @staticmethod
    def _hit(level: EliasFano, at: np.ndarray, key: np.ndarray, high: np.ndarray) -> np.ndarray:
        inside = np.flatnonzero(at < high)
        inside = inside[level[at[inside]] == key[inside]] if len(inside) else inside
        out = np.full(len(at), -1, np.int64)
        out[inside] = at[inside]
        return out

    def code(self, level: int, place: np.ndarray) -> np.ndarray:
        """Codes at places of a level; 0 at -1."""
        out = np.zeros(len(place), np.uint16)
        known = np.flatnonzero(place >= 0)
        out[known] = self.codes[level - 1][place[known]]
        return out

    def to_bytes(self) -> bytes:
        sequences = [self.vocabulary, *self.levels, *self.pointers]
        sizes = [len(self.levels), len(self.counts), *[x for e in sequences for x in (e.n, e.width, len(e.lower), len(e.upper))], *[x for c in self.codes for x in (c.usual, len(c.marks), len(c.table), len(c.places))]]
        arrays = [a for e in sequences for a in (e.lower, e.upper, e.ones)] + [a for c in self.codes for a in (c.marks, c.before, c.table, c.places)]
        return joined([np.array([len(sizes)], np.int64), np.array(sizes, np.int64), self.counts, *arrays])

    @classmethod
    def map(cls, buffer: object) -> Trie:
        """Views into a buffer that holds to_bytes()."""
        b = Buffer(buffer)
        n, firsts, *sizes = (int(x) for x in b.take(np.int64, int(b.take(np.int64, 1)[0])))
        counts, sequences = b.take(U64, firsts), []
        for k in range(2 * n):  # the vocabulary, levels and pointers
            size, width, lower, upper = sizes[4 * k : 4 * k + 4]
            sequences.append(EliasFano(size, width, b.take(U64, lower), b.take(U64, upper), b.take(np.uint32, upper)))
        rest = sizes[8 * n :]
        codes = [Coded(usual, b.take(U64, m), b.take(np.uint32, m), b.take(np.uint16, t), b.take(U64, p)) for usual, m, t, p in zip(*[rest[k::4] for k in range(4)], strict=True)]
        return cls(sequences[0], sequences[1 : n + 1], sequences[n + 1 :], codes, counts)
