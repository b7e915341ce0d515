"""LM scoring with trigram tries that no machine holds whole.

Texts become chunks of word numbers, files in the shared folder. Chunks first ask shards of words (by hash) for each
word's count in training and its number; frequent words have small ones. Then every chunk sends its distinct trigrams,
with their counts in training, to shards by their first word. A shard sums the counts, builds an Elias-Fano trie of
the trigrams seen in training, writes it to the shared folder, maps the file, and answers every chunk from there:
level by level, a word is sought among the successors of its context. So counts cover the whole corpus, the memory
of a task is bounded by a chunk or a shard, and what is exchanged has been reduced to distinct trigrams before.
The files stay: score_texts() scores other texts by them.

First words with very many occurrences are spread over shards by the second word, and pairs of words with very many
different successors by the third one; which ones these are is known to all chunks beforehand.

Smoothing: P(w | h) = (c(hw) + m P(w | h')) / (c(h) + m), with h' the shorter context, down to
P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). m depends on c(h) only, so P sums to 1. The trie holds the shares
c(hw) / (c(h) + m) as codes; a share and the count of the context above give c(hw) back, which is what shards answer: it
is small, mostly, where codes are not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from .common import U64, Interned, durable, fold, id_text, mapped_file, mix64, shared_folder, stored_file, with_id_of
from .trie import Buffer, EliasFano, Trie, _pack, _unpack, joined, quantise, share_of

#: m of one word that training has c times is PRIOR * c ** GROWTH: a word goes on meeting new ones, at a rate that falls slowly.
PRIOR, GROWTH = 4.0, 0.9
#: The part of P that two words leave to the shorter context: ONCE where training has them once, which says little of what follows; AGAIN * (2 / c) ** FADE from the second time on.
ONCE, AGAIN, FADE = 0.8, 0.4, 0.2
FOLDS, HELD_OUT = 5, 1
CHUNK_WORDS = 1_400_000
#: Trigrams that a shard gets, about; and occurrences of one first word, or different successors of one pair, beyond which these are spread.
SHARD_ENTRIES, HOT = 1_000_000, 500_000
#: Pairs that are spread, at most: their list is told to all chunks (16 MB).
HOT_PAIRS = 1 << 20
#: Numbers of what stands behind and before a text; of the most frequent word of shard 0.
PAD, START, WORDS = 0, 1, 2
#: Hashes of the end of a text, which is a word, and of the context before its first word.
END_HASH, START_HASH = U64(0x1D8AF066F0AE3D5B), U64(0x6E2F1A9C4B7D8035)
_SPREAD = U64(0x9E3779B97F4A7C15)


def _slim(a: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 on, in the narrowest unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its kind and length, as one compressed blob. Bytes of equal weight lie together, which compresses better."""
    head = np.array([x for a in arrays for x in (ord(a.dtype.char), len(a))], np.int64)
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(head)).tobytes() + head.tobytes() + b"".join(planes))


def _open(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    head, at, out = np.frombuffer(raw, np.int64, n, 8), 8 + 8 * n, []
    for kind, size in zip(head[::2], head[1::2], strict=True):
        wide = np.dtype(chr(kind)).itemsize
        planes = np.frombuffer(raw, np.uint8, wide * int(size), at).reshape(wide, int(size))
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(np.dtype(chr(kind))))
        at += planes.nbytes
    return out


def reserve(count: np.ndarray, order: int) -> np.ndarray:
    """m of a context of order - 1 words that training has so often."""
    c = np.maximum(count, 1.0)
    if order == 2:
        return PRIOR * c**GROWTH
    left = np.where(c < 2, ONCE, AGAIN * (2 / np.maximum(c, 2)) ** FADE)
    return c * left / (1 - left)


def _shares(count: np.ndarray, above: np.ndarray, order: int) -> np.ndarray:
    above = above.astype(np.float64)
    return count / (above + reserve(above, order))


# Chunks ----------------------------------------------------------------------------------------------------------


def chunked(docs: DataFrame) -> DataFrame:
    """Rows of about CHUNK_WORDS words: chunk, doc_ids (as text), lengths (words), held (flags), path. The file there has the hashes of the distinct words, and the words as places in them."""
    folder = f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}"

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, made = TaskContext.get().partitionId() << 32, 0
        known, ids, docs_in, lengths, held = Interned(), [], [], [], []

        def row() -> pd.DataFrame:
            seq = np.array(ids, np.int64)
            count = np.bincount(seq, minlength=len(known))
            order = np.argsort(-count, kind="stable")  # frequent words get small numbers, whose bytes compress
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            path = f"{folder}/chunk-{base + made}-{uuid.uuid4().hex}"
            stored_file(path, _squeeze(known.hashes()[order], _slim(rank[seq])))
            return pd.DataFrame({"chunk": [base + made], "doc_ids": [docs_in], "lengths": [lengths], "held": [held], "path": [path]})

        for batch in batches:
            for doc, text, out in zip(batch["id"], batch["text"], batch["held"], strict=True):
                words = fold(text)
                ids.extend(map(known.__getitem__, words))
                docs_in.append(doc)
                lengths.append(len(words))
                held.append(bool(out))
                if len(ids) + len(docs_in) >= CHUNK_WORDS:
                    yield row()
                    made += 1
                    known, ids, docs_in, lengths, held = Interned(), [], [], [], []
        if docs_in:
            yield row()

    key = id_text(docs)
    out = F.crc32(F.coalesce(key, F.lit(""))) % FOLDS == HELD_OUT
    schema = "chunk long, doc_ids array<string>, lengths array<int>, held array<boolean>, path string"
    return durable(docs.select(key.alias("id"), "text", out.alias("held")).mapInPandas(chunks, schema))


@dataclass(frozen=True)
class Model:
    """folder: where the shards' files are; bits of the numbers of shards; hot_from: HOT; total, types, texts: N, V and texts in training; hot: hashes, in order, and counts of the pairs that are spread."""

    folder: str
    word_bits: int
    gram_bits: int
    hot_from: int
    total: int
    types: int
    texts: int
    hot: tuple[np.ndarray, np.ndarray]


class Chunk:
    """One chunk's tokens (the words of each text, then its end), and what the shards have told of them so far."""

    def __init__(self, path: str, lengths: object, held: object) -> None:
        words, seq = _open(mapped_file(path))
        lengths = np.array(lengths, np.int64)
        self.counts = lengths + 1
        self.ends = np.cumsum(self.counts) - 1
        self.first = self.ends - lengths
        self.train = np.repeat(~np.array(held, bool), self.counts)
        order = np.argsort(words)
        self.words = np.append(words[order], END_HASH) if len(words) else np.array([END_HASH])
        self.by_hash = np.argsort(self.words, kind="stable")  # the end of texts is a word among the others
        self.words = self.words[self.by_hash]
        place = np.empty(len(words), np.int64)
        rank = np.empty(len(self.words), np.int64)
        rank[self.by_hash] = np.arange(len(self.words))
        place[order] = rank[: len(words)]
        self.token = np.full(len(self.train), rank[-1], np.int32)
        text = np.ones(len(self.train), bool)
        text[self.ends] = False
        self.token[text] = place[seq]

    def ask_words(self, chunk: int, bits: int) -> pd.DataFrame:
        count = np.bincount(self.token, self.train, len(self.words)).astype(np.int64)
        at = _bounds(self.words, bits)
        rows = [(chunk, s, _squeeze(np.diff(self.words[at[s] : at[s + 1]], prepend=U64(0)), _slim(count[at[s] : at[s + 1]]))) for s in map(int, np.flatnonzero(np.diff(at)))]
        return pd.DataFrame(rows, columns=["chunk", "shard", "question"])

    def learn_words(self, answers: pd.DataFrame, model: Model) -> None:
        """Counts and numbers of the distinct words: numbers, with the specials, in order; place: each token's place in them, -1 for words that training has not."""
        parts = [_open(b) for b in answers.sort_values("shard")["answer"]]
        count, rank = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        shard = (self.words >> U64(64 - model.word_bits)).astype(np.int64) if model.word_bits else 0
        number = WORDS + (rank << model.word_bits) + shard
        seen = np.flatnonzero(count > 0)
        seen = seen[np.argsort(number[seen])]
        self.numbers = np.concatenate([[PAD, START], number[seen]]).astype(U64)
        self.above = np.concatenate([[0, model.texts], count[seen]])
        place = np.full(len(self.words), -1, np.int64)
        place[seen] = WORDS + np.arange(len(seen))
        self.place, self.word_count = place[self.token], count[self.token]
        self.p1 = (self.word_count + 0.5) / (model.total + 0.5 * (model.types + 1))

    def neighbours(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What stands before and behind each token."""
        before, behind = np.concatenate([[START], place[:-1]]), np.append(place[1:], PAD)
        before[self.first], behind[self.ends] = START, PAD
        return before, behind

    def grams(self, place: np.ndarray, size: int) -> Grams:
        """place: of each token, below size, -1 for what needs not be asked for."""
        before, behind = self.neighbours(place)
        use = np.flatnonzero((before >= 0) & (place >= 0))
        pairs, pair = np.unique(before[use] * size + place[use], return_inverse=True)
        triples, triple = np.unique(pair * size + np.maximum(behind[use], PAD), return_inverse=True)
        return Grams(use, pairs // size, pairs % size, pair, triples // size, triples % size, triple, np.bincount(triple, self.train[use], len(triples)).astype(np.int64))


@dataclass
class Grams:
    """Distinct pairs (a, b) and trigrams (pair, c), in order; pair and triple: those of the tokens ``use``; count: of the trigrams in training."""

    use: np.ndarray
    a: np.ndarray
    b: np.ndarray
    pair: np.ndarray
    context: np.ndarray
    c: np.ndarray
    triple: np.ndarray
    count: np.ndarray


def _bounds(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard's entries begin among sorted keys, and the end."""
    if not bits:
        return np.array([0, len(keys)])
    edges = np.arange(1, 1 << bits).astype(U64) << U64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * _SPREAD + b)


def _spread(chunk: Chunk, g: Grams, model: Model) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Shard of each trigram; counts of the pairs that are spread, -1 for others; the trigrams of each shard, in order."""
    a, b, c = chunk.numbers[g.a], chunk.numbers[g.b], chunk.numbers[g.c]
    key = mix64(a * _SPREAD + b % (1 + chunk.above[g.a] // model.hot_from).astype(U64))
    told = np.full(len(a), -1, np.int64)
    hashes, counts = model.hot
    if len(hashes):
        own = pair_hash(a, b)
        at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
        told = np.where(hashes[at] == own, counts[at], -1)
    key = key[g.context]
    hot = np.flatnonzero(told[g.context] >= 0)
    if len(hot):
        key[hot] = mix64(key[hot] + c[hot] % (2 + told[g.context[hot]] // model.hot_from).astype(U64) * _SPREAD + U64(1))
    shard = (key >> U64(64 - model.gram_bits)).astype(np.int64) if model.gram_bits else np.zeros(len(key), np.int64)
    order = np.argsort(_slim(shard), kind="stable")
    return shard, told, np.split(order, np.searchsorted(shard[order], np.arange(1, 1 << model.gram_bits)))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal numbers begin, and their lengths."""
    begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)
    return begin, np.diff(np.append(begin, len(x)))


def ask_grams(chunk_no: int, chunk: Chunk, model: Model) -> pd.DataFrame:
    """A chunk's questions, a row for each shard: first words with their numbers of second ones, these with their numbers of third ones, these with their counts; first words that are spread, and pairs that are, and their counts. Words are told as differences to the one before, under one first word."""
    g = chunk.grams(chunk.place, len(chunk.numbers))
    _, told, parts = _spread(chunk, g, model)
    rows = []
    for shard, own in enumerate(parts):
        if len(own):
            begin, n_third = _runs(g.context[own])
            pair = g.context[own[begin]]
            at, n_second = _runs(g.a[pair])
            a = g.a[pair[at]]
            wide, hot = np.flatnonzero(chunk.above[a] >= model.hot_from), np.flatnonzero(told[pair] >= 0)
            second = chunk.numbers[g.b[pair]]
            step = np.diff(second, prepend=U64(0))
            step[at] = second[at]
            blob = _squeeze(
                _slim(np.diff(chunk.numbers[a], prepend=U64(0))), _slim(n_second), _slim(step), _slim(n_third), _slim(chunk.numbers[g.c[own]]), _slim(g.count[own]),
                _slim(wide), _slim(chunk.above[a[wide]]), _slim(hot), _slim(told[pair[hot]]),
            )
            rows.append((chunk_no, shard, blob))
    return pd.DataFrame(rows, columns=["chunk", "shard", "question"])


def chunk_scores(chunk: Chunk, answers: pd.DataFrame, model: Model) -> np.ndarray:
    """The tokens' log10 probabilities, from the shards' counts of pairs and trigrams."""
    g = chunk.grams(chunk.place, len(chunk.numbers))
    two, three = np.zeros(len(g.a)), np.zeros(len(g.c))
    blobs = dict(zip(answers.shard, answers.answer, strict=True))
    for shard, own in enumerate(_spread(chunk, g, model)[2]):
        if len(own):
            begin, _ = _runs(g.context[own])
            two[g.context[own[begin]]], three[own] = _open(blobs[shard])
    before, _ = chunk.neighbours(chunk.place)
    above = np.where(before >= 0, chunk.above[before], 0)
    seen, behind = np.zeros(len(above)), np.zeros(len(above))  # how often training has the pair that ends here, and that with the next word
    seen[g.use], behind[g.use] = two[g.pair], three[g.triple]
    m = reserve(above, 2)
    p2 = (seen + m * chunk.p1) / (above + m)
    m = reserve(seen, 3)[:-1]
    p = np.append(p2[:1], (behind[:-1] + m * p2[1:]) / (seen[:-1] + m))
    p[chunk.first] = p2[chunk.first]
    return np.log10(p)


# Shards ----------------------------------------------------------------------------------------------------------


def words_file(words: np.ndarray, count: np.ndarray, rank: np.ndarray) -> bytes:
    """Hashes (as 63 bits) in order, counts and ranks, packed."""
    level = EliasFano.of(words >> U64(1))
    width = [int(x.max()).bit_length() if len(x) else 0 for x in (count, rank)]
    packed = [_pack(x.astype(U64), w) for x, w in zip((count, rank), width, strict=True)]
    sizes = np.array([level.n, level.width, len(level.lower), len(level.upper), *width, *map(len, packed)], np.int64)
    return joined([sizes, level.lower, level.upper, level.ones, *packed])


def find_words(buffer: object, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and ranks of words, by their hashes; 0 and 0 for those that are not there."""
    b = Buffer(buffer)
    n, width, lower, upper, w1, w2, n1, n2 = (int(x) for x in b.take(np.int64, 8))
    level = EliasFano(n, width, b.take(U64, lower), b.take(U64, upper), b.take(np.uint32, upper))
    at = Trie(level, [level], [], [], words[:0]).root(words >> U64(1))
    known = np.flatnonzero(at >= 0)
    out = []
    for w, packed in ((w1, b.take(U64, n1)), (w2, b.take(U64, n2))):
        x = np.zeros(len(words), np.int64)
        x[known] = _unpack(packed, w, at[known]).astype(np.int64)
        out.append(x)
    return out[0], out[1]


def _answer_words(folder: str, build: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Counts of words over all chunks, and numbers by falling count; the shard's tokens and types are told in its first row."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        opened, path = [_open(b) for b in group.question], f"{folder}/words-{group.shard.iloc[0]}"
        asked, inverse = np.unique(np.concatenate([np.cumsum(x[0], dtype=U64) for x in opened]), return_inverse=True)
        tokens = types = 0
        if build:
            count = _summed(inverse, np.concatenate([x[1].astype(np.int64) for x in opened]), len(asked))
            words, count = asked[count > 0], count[count > 0]
            rank = np.empty(len(words), np.int64)
            rank[np.lexsort((words, -count))] = np.arange(len(words))
            stored_file(path, words_file(words, count, rank))
            tokens, types = int(count.sum()), len(words)
        count, rank = find_words(mapped_file(path), asked)
        ends = np.cumsum([len(x[0]) for x in opened])[:-1]
        out = group[["chunk", "shard"]].copy()
        out["answer"] = [_squeeze(_slim(n), _slim(r)) for n, r in zip(np.split(count[inverse], ends), np.split(rank[inverse], ends), strict=True)]
        out["tokens"], out["types"] = 0, 0
        out.iloc[0, 3:5] = tokens, types
        return out

    return answer


def _summed(place: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Whole sums of 64 bits by place."""
    out = np.zeros(n, np.int64)
    np.add.at(out, place, count)
    return out


def _ranked(context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (context, word) in order: their contexts and words, and the place of every one given."""
    names, at = (np.unique(word, return_inverse=True)) if len(word) and (int(context.max()) + 1) * (int(word.max()) + 1) >= 1 << 63 else (None, word)
    size = int(at.max()) + 1 if len(at) else 1
    pairs, inverse = np.unique(context * size + at, return_inverse=True)
    word = pairs % size
    return pairs // size, word if names is None else names[word], inverse


def _answer_grams(model: Model, build: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The shard's trie, which is written to its file, and every chunk's pairs and trigrams looked up there, each distinct one once."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        opened, path = [_open(b) for b in group.question], f"{model.folder}/grams-{group.shard.iloc[0]}"
        join = lambda k, kind=np.int64: np.concatenate([x[k].astype(kind) for x in opened])
        first = np.concatenate([np.cumsum(x[0].astype(np.int64)) for x in opened])
        words, a = np.unique(first, return_inverse=True)
        step, runs = join(2), join(1)
        total, begin = np.cumsum(step), np.cumsum(runs) - runs
        second = total - np.repeat(total[begin] - step[begin], runs) if len(step) else step
        a2, b2, pair = _ranked(np.repeat(a, runs), second)
        context, c3, triple = _ranked(np.repeat(pair, join(3)), join(4))
        if build:
            # All trigrams of a first word, and of a pair, are here, but for those that are spread; these tell their counts.
            listed = lambda k, part: np.concatenate([x[k].astype(np.int64) + o for x, o in zip(opened, np.cumsum([0, *[len(x[part]) for x in opened]]), strict=False)])
            count = _summed(triple, join(5), len(c3))
            of_pair = _summed(context, count, len(a2))
            above = _summed(a2, of_pair, len(words))
            above[a[listed(6, 0)]] = join(7)
            of_pair[pair[listed(8, 2)]] = join(9)
            stored_file(path, trie_of(words, above, a2, b2, of_pair, context, c3, count).to_bytes())
        two, three = counts_of(Trie.map(mapped_file(path)), words, a2, b2, context, c3)
        two, three = two[pair], three[triple]
        out = group[["chunk", "shard"]].copy()
        cut = lambda x, k: np.split(x, np.cumsum([len(o[k]) for o in opened])[:-1])
        out["answer"] = [_squeeze(_slim(x), _slim(y)) for x, y in zip(cut(two, 2), cut(three, 4), strict=True)]
        return out

    return answer


def counts_of(trie: Trie, words: np.ndarray, a: np.ndarray, b: np.ndarray, context: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often training has pairs (place of the first word among words, b) and trigrams (place of the pair, c): level by level, a share that the trie has and the count above it give the count; whole up to some hundreds, from there on as near as the codes are."""
    root = trie.root(words)
    above = np.where(root >= 0, trie.counts[np.maximum(root, 0)].astype(np.float64) if len(trie.counts) else 0.0, 0.0)[a]
    second = trie.below(1, root[a], trie.named(b))
    two = np.rint(share_of(trie.code(1, second)) * (above + reserve(above, 2)))
    third = trie.below(2, second[context], trie.named(c))
    three = np.rint(share_of(trie.code(2, third)) * (two + reserve(two, 3))[context])
    return two.astype(np.int64), three.astype(np.int64)


def trie_of(words: np.ndarray, above: np.ndarray, a: np.ndarray, b: np.ndarray, of_pair: np.ndarray, context: np.ndarray, c: np.ndarray, count: np.ndarray) -> Trie:
    """words and how often they are contexts; pairs (place of the word, b) and their counts; trigrams (place of the pair, c) and their counts. Those with count 0 are left out."""
    kept = lambda use: np.cumsum(use) - 1
    grown = np.bincount(context[count > 0], minlength=len(a)) > 0  # a pair that is spread may have no successor here
    live = np.bincount(a[grown], minlength=len(words)) > 0
    two, three = _shares(of_pair, above[a], 2), _shares(count, of_pair[context], 3)
    use = count > 0
    return Trie.of(words[live], above[live], [(kept(live)[a[grown]], b[grown], quantise(two[grown])), (kept(grown)[context[use]], c[use], quantise(three[use]))])


# The whole -------------------------------------------------------------------------------------------------------


def _each(chunks: DataFrame, ask: Callable[[int, Chunk], pd.DataFrame], schema: str) -> DataFrame:
    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for no, path, lengths, held in zip(batch.chunk, batch.path, batch.lengths, batch.held, strict=True):
                yield ask(no, Chunk(path, lengths, held))

    return chunks.mapInPandas(asked, schema)


def _with_answers(chunks: DataFrame, answers: DataFrame) -> PandasCogroupedOps:
    """Chunks with their answers. These are few bytes with much to do, so they are not to be merged into fewer tasks."""
    tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = lambda df: df.repartition(tasks, "chunk").groupBy("chunk")
    return by(chunks).cogroup(by(answers))


QUESTION, ANSWER = "chunk long, shard int, question binary", "chunk long, shard int, answer binary"


def _hot_pairs(chunks: DataFrame, n_chunks: int) -> list[int]:
    """Hashes of the pairs of words (by hash) with HOT different successors or more, summed over chunks.

    A chunk tells a pair from that number on from which as many in every chunk would make a hot one; so none is missed.
    """
    hot = max(HOT, n_chunks * CHUNK_WORDS // HOT_PAIRS)

    def heavy(_: int, chunk: Chunk) -> pd.DataFrame:
        g = chunk.grams(chunk.token.astype(np.int64) + WORDS, len(chunk.words) + WORDS)
        n = np.bincount(g.context, minlength=len(g.a))
        at = np.flatnonzero(n >= max(1, hot // max(1, n_chunks)))
        names = np.concatenate([[U64(0), START_HASH], chunk.words])
        return pd.DataFrame({"pair": pair_hash(names[g.a[at]], names[g.b[at]]).view(np.int64), "n": n[at]})

    found = _each(chunks, heavy, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= hot)
    return [r.pair for r in found.select("pair").collect()]


def _hot_counts(chunks: DataFrame, answers: DataFrame, pairs: list[int], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The pairs' hashes by their words' numbers, in order, and their counts in training."""
    listed = np.sort(np.array(pairs, np.int64).view(U64))

    def counted(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(*rows[["path", "lengths", "held"]].iloc[0])
        chunk.learn_words(told, model)
        g = chunk.grams(chunk.token.astype(np.int64) + WORDS, len(chunk.words) + WORDS)
        names = np.concatenate([[U64(0), START_HASH], chunk.words])
        own = pair_hash(names[g.a], names[g.b])
        at = np.flatnonzero(listed[np.minimum(np.searchsorted(listed, own), len(listed) - 1)] == own)
        number = np.zeros(len(names), U64)
        number[START] = START
        number[WORDS + chunk.token[chunk.place >= 0]] = chunk.numbers[chunk.place[chunk.place >= 0]]
        n = np.bincount(g.context, g.count, len(g.a)).astype(np.int64)
        at = at[n[at] > 0]
        return pd.DataFrame({"pair": pair_hash(number[g.a[at]], number[g.b[at]]).view(np.int64), "n": n[at]})

    rows = _with_answers(chunks, answers).applyInPandas(counted, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    found = sorted((r.pair % (1 << 64), r.n) for r in rows)
    return np.array([x[0] for x in found], U64), np.array([x[1] for x in found], np.int64)


def _bits(entries: float) -> int:
    return max(0, int(np.ceil(np.log2(max(1.0, entries / SHARD_ENTRIES)))))


def _scored(docs: DataFrame, model: Model | None) -> tuple[Model, DataFrame]:
    """The model (learned from docs where none is given), and the docs' scores."""
    build = model is None
    chunks = chunked(docs)
    n_chunks = chunks.count()
    if model is None:  # a chunk has at most CHUNK_WORDS trigrams; shards grow in number with chunks, not in size
        folder = f"{shared_folder(docs.sparkSession)}/{uuid.uuid4().hex}"
        model = Model(folder, _bits(n_chunks * CHUNK_WORDS / 4), _bits(n_chunks * CHUNK_WORDS), HOT, 0, 0, 0, (np.empty(0, U64), np.empty(0, np.int64)))
    word_bits = model.word_bits
    asked = _each(chunks, lambda no, chunk: chunk.ask_words(no, word_bits), QUESTION)
    told = durable(asked.groupBy("shard").applyInPandas(_answer_words(model.folder, build), f"{ANSWER}, tokens long, types long"))
    words = told.select("chunk", "shard", "answer")
    if build:
        hot = _hot_pairs(chunks, n_chunks)
        total, types = (int(x or 0) for x in told.agg(F.sum("tokens"), F.sum("types")).first())
        texts = int(chunks.select(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0)
        model = Model(model.folder, word_bits, model.gram_bits, HOT, total, types, texts, model.hot)
        if hot:
            model = Model(**model.__dict__ | {"hot": _hot_counts(chunks, words, hot, model)})

    def learned(rows: pd.DataFrame, told: pd.DataFrame) -> Chunk:
        chunk = Chunk(*rows[["path", "lengths", "held"]].iloc[0])
        chunk.learn_words(told[told.level == 1], model)
        return chunk

    def ask(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        return ask_grams(int(rows.chunk.iloc[0]), learned(rows, told), model)

    def finish(rows: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        chunk = learned(rows, told)
        doc = np.repeat(np.arange(len(chunk.counts)), chunk.counts)
        per_doc = lambda x: np.bincount(doc, x, len(chunk.counts))
        score = chunk_scores(chunk, told[told.level == 2], model)
        return pd.DataFrame(
            {
                "doc_id": rows.doc_ids.iloc[0], "held_out": rows.held.iloc[0], "n_tokens": chunk.counts, "n_known": per_doc(chunk.word_count > 0).astype(np.int64),
                "train_tokens": model.total, "base_score": per_doc(np.log10(chunk.p1)), "score": per_doc(score),
            }
        )

    level = lambda df, k: df.select(F.lit(k).alias("level"), "chunk", "shard", "answer")
    meta = chunks.drop("doc_ids")
    asked = _with_answers(meta, level(words, 1)).applyInPandas(ask, QUESTION)
    grams = asked.groupBy("shard").applyInPandas(_answer_grams(model, build), ANSWER)
    answers = level(words, 1).union(level(grams, 2))
    schema = "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = _with_answers(chunks, answers).applyInPandas(finish, schema)
    return model, with_id_of(out, docs)


def learned_model(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model that the docs give, its files in the shared folder, and score_documents(docs), which has been run: that writes the files."""
    model, scores = _scored(docs, None)
    return model, durable(scores)


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Scores, as score_documents gives them, of any texts by a model that was learned before. Nothing is learned from them; held_out tells the fold as ever."""
    return _scored(docs, model)[1]


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the rows whose id's CRC-32 modulo FOLDS is not HELD_OUT; a null id counts as the empty text.
    Null and empty texts have one token, their end. Repeated rows are counted and scored as often as they come, and
    equal texts get equal scores. A very long text is in one chunk, so a task holds its words whole. Ids are never read
    by Python as numbers. Only doc_id and text are read, whatever other columns are called; an empty table gives an empty one.
    """
    return _scored(docs, None)[1]
