"""SimHash fingerprints, and links between near-equal ones by pigeonring filtering.

A fingerprint is cut into m segments laid in a ring. If two fingerprints differ in at most t bits, then from some
segment on every chain of l consecutive segments differs in at most floor(l * t / m) bits (the pigeonring principle,
which is stronger than the pigeonhole one). So a candidate is pruned unless such a chain exists, before its bits are
counted in full. Candidates share a key that the chain's start implies; with t = 2 and m = 4 the first segment is
equal and one of the next two is, so the six pairs of segments are keys and no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, Interned, durable, fold, free_name, id_text, members, mix64, slices, split_by, with_id_of
from .components import connected_components

BITS = 64
BATCH_WORDS = 300_000
#: Fingerprints that share a key in larger numbers are linked through their midpoints, not pair by pair.
BUCKET = 64


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """All n-word shingles, repeats included; the whole sequence if it is shorter; none without words."""
    return [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [b" ".join(words)] if words else []


def majority(hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes, the 64 bits that over half of them have; empty runs give 0."""
    out = np.zeros(len(counts), U64)
    full = counts > 0
    if full.any():
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS)
        votes = np.add.reduceat(bits, starts[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * votes > counts[full, None], axis=1).reshape(-1).view(">u8").astype(U64)
    return out


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fp (long, the fingerprint's 64 bits) of every row; null and empty texts have 0."""
    xx = xxhash.xxh64_intdigest

    def prints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"]
            for a, b in slices([len(t) // 6 + 1 if isinstance(t, str) else 1 for t in texts], BATCH_WORDS):
                hashes, counts = [], []
                for text in texts.iloc[a:b]:
                    own = shingles(fold(text), words)
                    hashes.extend([xx(s, 42) for s in own])
                    counts.append(len(own))
                n = np.array(counts, np.int64)
                fp = majority(np.array(hashes, U64), np.cumsum(n) - n, n)
                yield pd.DataFrame({"doc_id": batch["doc_id"].iloc[a:b].array, "fp": fp.view(np.int64)})

    return with_id_of(docs.select(id_text(docs).alias("doc_id"), "text").mapInPandas(prints, "doc_id string, fp long"), docs)


def segment_masks(m: int) -> list[int]:
    edges = [BITS * i // m for i in range(m + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def chain_holds(x: Column, m: int, t: int) -> Column:
    """x: the exclusive or of two fingerprints. Whether from some segment on all chains stay within their budgets."""
    d = [F.bit_count(x.bitwiseAND(F.lit(_signed(mask)))) for mask in segment_masks(m)]
    found = F.lit(False)
    for i in range(m):
        run, holds = F.lit(0), F.lit(True)
        for length in range(1, m + 1):
            run = run + d[(i + length - 1) % m]
            holds = holds & (run <= length * t // m)
        found = found | holds
    return found


def linked_fingerprints(distinct: DataFrame) -> DataFrame:
    """distinct: (fp), each once. Pairs (a, b) whose closure links all fingerprints that differ in at most 2 bits.

    Keys with at most BUCKET fingerprints give the pairs themselves. Of a larger bucket every fingerprint names the
    values at distance 0 and 1 within the bits that the bucket does not share; two fingerprints within 2 bits name a
    common one, and all that name a value are within 2 bits of each other, so each is linked with the least of them.
    That is exact, and linear in the bucket's size.
    """
    m, t = 4, 2
    masks = segment_masks(m)
    tables = F.array(*[F.struct(F.lit(k).alias("table"), F.lit(_signed(masks[i] | masks[j])).alias("mask")) for k, (i, j) in enumerate(combinations(range(m), 2))])
    keyed = distinct.select("fp", F.explode(tables).alias("t")).select("fp", F.col("t.table").alias("table"), F.col("t.mask").alias("mask"), F.col("fp").bitwiseAND(F.col("t.mask")).alias("key"))
    sizes = keyed.groupBy("table", "key").agg(F.count("fp").alias("n")).filter("n > 1")
    sized = keyed.join(sizes, ["table", "key"])
    few = sized.filter(F.col("n") <= BUCKET)
    other = few.select("table", "key", F.col("fp").alias("b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = few.select("table", "key", F.col("fp").alias("a")).join(other, ["table", "key"]).filter("a > b").filter(chain_holds(x, m, t)).filter(F.bit_count(x) <= t).select("a", "b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    many = sized.filter(F.col("n") > BUCKET).select("fp", F.explode(F.filter(flips, lambda f: f.bitwiseAND(F.col("mask")) == 0)).alias("flip"))
    named = many.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("middle")).distinct()
    least = named.groupBy("middle").agg(F.min("fp").alias("b"), F.count("fp").alias("n")).filter("n > 1").select("middle", "b")
    return pairs.union(named.join(least, "middle").filter("fp > b").select(F.col("fp").alias("a"), "b")).distinct()


def simhash_components(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Fingerprints over word shingles (A-Z lower-cased, repeats counted) are linked at 2 or fewer differing bits;
    component_id is the smallest doc_id that links reach. Null and empty texts have fingerprint zero and are linked
    like any other; null ids are passed over unless a component has no other. Equal fingerprints are collapsed
    first, so copies and repeated rows cost nothing. A bit that exactly half the hashes have is 0. Long texts are read
    whole. Ids are never read by Python as numbers. Only doc_id and text are read, whatever other columns are called; an
    empty table gives an empty one.
    """
    fps = durable(fingerprints(docs, words))
    groups = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(linked_fingerprints(groups.select("fp"))).withColumnRenamed("node", "fp")
    rooted = groups.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies at a similarity of word shingles -------------------------------------------------------------------

#: Shingles seen COMMON_SEEN times or more in about SAMPLE texts come last in the order of shingles, the COMMON most
#: frequent of them at least. The order decides how long the runs of keys are, never which pairs are found.
SAMPLE, COMMON_SEEN, COMMON = 8192, 3, 1 << 16
#: Neighbours in a run of one key that a document is compared with at first. Up to FEW near ones are all checked; of
#: more, the NEAREST ones, and the documents for which some were passed over are compared again under that key, block
#: against block, a block being about so many documents and shingles at most.
WINDOW, FEW, NEAREST, BLOCK, BLOCK_SHINGLES = 48, 12, 3, 4096, 8_000_000


def shingle_hashes(texts: list, n: int) -> list[np.ndarray]:
    """64-bit hashes of the n-word shingles of each text, each once and in order; of the whole text if it is shorter."""
    known = Interned()
    ids = [np.array([known[w] for w in fold(text)], np.int64) for text in texts]
    hashes = known.hashes(42)
    odd = mix64(np.arange(1, n + 1, dtype=U64)) | U64(1)
    out = []
    for own in ids:
        m = min(n, len(own))
        w, end = hashes[own], len(own) - m + 1
        out.append(np.unique(mix64(sum((w[k : end + k] * odd[k] for k in range(m)), np.full(end, m, U64)))) if m else np.empty(0, U64))
    return out


def prefix(h: np.ndarray, similarity: float, common: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The first shingles of a text in an order that all texts share: rare before common, then by hash.

    Two sets of this Jaccard similarity share at least similarity * n shingles, n being the greater size; so the first
    one that they share is among the first n - ceil(similarity * n) + 1 of each. Texts without words share the key 0.
    """
    if not len(h):
        return np.zeros(1, U64)
    first = len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1
    if len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        h = h[np.lexsort((h, np.where(common[at] == h, seen[at], 0)))]
    return h[:first]


def short(h: np.ndarray) -> np.ndarray:
    """32 bits of each hash, each once and in order, which halves what is exchanged. Of n shingles about n**2 / 2**33 meet another one by chance: a text of 2,000 words has one such in a thousand times."""
    return np.unique((h >> U64(32)).astype(np.uint32))


SKETCH_BITS, SEGMENTS = 512, 8


def sketch(h: np.ndarray) -> np.ndarray:
    """Parities of how many short hashes fall to each bit, as longs: as many bits as shingles at least, a power of two.

    Two sets differ in at least as many elements as their sketches do in bits: what both have cancels out.
    """
    bits = max(SKETCH_BITS, 1 << max(0, len(h) - 1).bit_length())
    parity = np.bincount(h.astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def folded(sketches: np.ndarray, longs: int) -> np.ndarray:
    """Sketches, a row each, as they would be with so many longs: bits that a smaller sketch has in one place are added up."""
    while sketches.shape[1] > longs:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def budget(na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """The most elements in which sets of these sizes differ if they have this Jaccard similarity."""
    return np.floor((na + nb) * (1 - similarity) / (1 + similarity) + 1e-6)


def differences(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """In how many bits sketches differ, row against row (or one against all); -1 where the pigeonring, or then the full count, shows that it is more than ``most``.

    The SEGMENTS segments lie in a ring; if the whole is within its budget, then from some segment on every chain of
    consecutive ones is within its share of it.
    """
    x = a ^ b
    d = np.bitwise_count(x.view(U64)).reshape(len(x), SEGMENTS, -1).sum(2, dtype=np.int64)
    share, live = most / SEGMENTS, np.zeros(len(x), bool)
    for i in range(SEGMENTS):
        chain, holds = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for length in range(1, SEGMENTS):
            chain = chain + d[:, (i + length - 1) % SEGMENTS]
            holds &= chain <= length * share
        live |= holds
    total = np.where(live, d.sum(1), -1)
    return np.where(total <= most, total, -1)


def _near_in_runs(keys: np.ndarray, size: np.ndarray, pos: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by key, then size; pos: the key's place in the text's order. Pairs of rows to be checked, and rows that have to come again.

    A row is compared with the next WINDOW rows that share its key and fit in size. What two texts share before and
    after a key that they share is bounded by its places. Rows of pairs that were passed over come again, and so do
    all rows of a key whose fitting rows reach beyond the window.
    """
    found, again = [], []
    for d in range(1, WINDOW + 2):
        i = np.flatnonzero((keys[:-d] == keys[d:]) & (size[d:] * similarity <= size[:-d] + 1e-6)) if len(keys) > d else np.empty(0, int)
        if not len(i):
            break
        if d > WINDOW:
            again.append(np.flatnonzero(np.isin(keys, keys[i])))
            break
        most = np.minimum(pos[i], pos[i + d]) + 1 + np.minimum(size[i] - pos[i], size[i + d] - pos[i + d]) - 1
        i = i[most * (1 + similarity) >= similarity * (size[i] + size[i + d]) - 1e-6]
        found.append(np.stack([i, i + d]))
    a, b = np.concatenate(found, 1) if found else np.empty((2, 0), np.int64)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    rank, count = np.arange(len(a)) - np.searchsorted(a, a), np.bincount(a, minlength=len(keys))[a] if len(a) else a
    keep = (count <= FEW) | (rank < NEAREST)
    again += [a[~keep], b[~keep]]
    return a[keep], b[keep], np.unique(np.concatenate(again))


def _candidates(every: DataFrame, similarity: float) -> DataFrame:
    """every: (no, n, keys). Pairs (a, b) of numbers to be checked, each once, and rows (a, null, key) of texts that have to come again under a key."""
    keyed = every.select("no", "n", F.posexplode("keys").alias("pos", "key"))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None  # the end of the last batch, whose runs may go on
        for batch in batches:
            part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            no, key = part.no.to_numpy(), part.key.to_numpy()
            a, b, again = _near_in_runs(key, part.n.to_numpy(), part.pos.to_numpy().astype(np.int64), similarity)
            found = pd.DataFrame({"a": np.minimum(no[a], no[b]), "b": np.maximum(no[a], no[b])}).drop_duplicates().assign(key=0)
            more = pd.DataFrame({"a": no[again], "b": -1, "key": key[again]})
            yield pd.concat([found, more], ignore_index=True)
            rest = part.tail(WINDOW + 1).reset_index(drop=True)

    found = keyed.repartition("key").sortWithinPartitions("key", "n", "no").mapInPandas(near, "a long, b long, key long")
    return found.distinct().withColumn("b", F.when(F.col("b") >= 0, F.col("b")))


def _common_shingles(docs: DataFrame, texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of the most frequent shingles of a sample of the texts, and how often they were seen."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in slices([len(t) // 6 + 1 for t in batch.text], BATCH_WORDS):
                yield pd.DataFrame({"h": np.concatenate([np.empty(0, U64), *shingle_hashes(list(batch.text.iloc[a:b]), words)]).view(np.int64)})

    some = texts.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, docs.count() // SAMPLE))) == 0)
    often = some.mapInPandas(listed, "h long").groupBy("h").agg(F.count("h").alias("c")).filter(F.col("c") >= COMMON_SEEN)
    top = often.orderBy(F.desc("c"), "h").limit(COMMON).toPandas()
    h, c = top.h.to_numpy(np.int64).view(U64), top.c.to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def _near_by_sketch(found: DataFrame, every: DataFrame, similarity: float) -> DataFrame:
    """found: (a, b); every: (no, n, sketch). The pairs, with the bits in which their sketches differ, that the sketches leave possible."""
    named = every.select("no", "n", "sketch")
    both = found.join(named.toDF("a", "na", "sa"), "a").join(named.toDF("b", "nb", "sb"), "b")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            most = budget(batch.na.to_numpy(), batch.nb.to_numpy(), similarity)
            differ = np.full(len(batch), -1, np.int64)
            la, lb = (batch[c].map(len).to_numpy() for c in ("sa", "sb"))
            for x, y in set(zip(la.tolist(), lb.tolist(), strict=True)):
                at = np.flatnonzero((la == x) & (lb == y))
                a, b = (folded(np.stack(list(batch[c].iloc[at])), min(x, y)) for c in ("sa", "sb"))
                differ[at] = differences(a, b, most[at])
            yield batch[["a", "b"]].assign(differ=differ)[differ >= 0]

    return both.mapInPandas(near, "a long, b long, differ long")


def shingle_sets(texts: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """texts: (id, text); asked: (no, id). (no, s): the short hashes of the word shingles of every text that is asked for."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in slices([len(t) // 6 + 1 for t in batch.text], BATCH_WORDS):
                part = batch.iloc[a:b]
                yield pd.DataFrame({"no": part.no.array, "s": [short(h).view(np.int32) for h in shingle_hashes(list(part.text), words)]})

    likely, _ = split_by(texts, "id", members(asked, "id"))
    return likely.join(asked, "id").dropDuplicates(["no"]).select("no", "text").mapInPandas(sets, "no long, s array<int>")


def similar_pairs(listed: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """listed: (no, s); pairs: (a, b). The pairs whose sets of word shingles have at least this Jaccard similarity."""
    both = pairs.join(listed.toDF("a", "sa"), "a").join(listed.toDF("b", "sb"), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= similarity * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def linking_pairs(listed: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """listed: (no, s); pairs: (a, b, differ). Similar pairs that join all that the similar pairs among these join.

    Of each text its likeliest pair is checked first; pairs within one group need no check after that.
    """
    first = durable(similar_pairs(listed, pairs.groupBy("b").agg(F.min(F.struct("differ", "a"))["a"].alias("a")), similarity))
    linked = connected_components(first)
    at = lambda c: linked.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    apart = pairs.select("a", "b").join(at("a"), "a", "left").join(at("b"), "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    return durable(first.union(similar_pairs(listed, apart, similarity)))


class Block:
    """Texts, with their groups, sizes and sketches by length; met: what texts that have been compared before have in common; sets, where they are at hand."""

    def __init__(self, nos: list[int], roots: list[int], sizes: list[int], met: list[int], sketches: list[np.ndarray], sets: list[np.ndarray] | None = None) -> None:
        self.nos, self.label, self.size, self.met, self.own, self.sets = nos, np.array(roots, np.int64), np.array(sizes, np.int64), np.array(met, np.int64), sketches, sets
        longs = np.array([len(x) for x in sketches], np.int64)
        self.classes = {int(k): (at := np.flatnonzero(longs == k), np.stack([sketches[i] for i in at])) for k in np.unique(longs)}

    @classmethod
    def of_sets(cls, nos: list[int], roots: list[int], sets: list[np.ndarray]) -> Block:
        return cls(nos, roots, [len(x) for x in sets], nos, [sketch(x) for x in sets], sets)

    def near(self, other: Block, i: int, similarity: float) -> np.ndarray:
        """Places of texts of other groups that may be similar to the i-th one of the other block, the likeliest first; only those behind it if it is this block."""
        s, size, label, met, after = other.own[i], other.size[i], other.label[i], other.met[i], i if other is self else -1
        places, differ = [], []
        for longs, (at, sketches) in self.classes.items():
            use = (at > after) & (self.label[at] != label) & (self.met[at] != met) & (np.minimum(size, self.size[at]) >= similarity * np.maximum(size, self.size[at]) - 1e-6)
            if use.any():
                k = min(longs, len(s))
                d = differences(folded(s[None, :], k), folded(sketches[use], k), budget(self.size[at[use]], size, similarity))
                places.append(at[use][d >= 0])
                differ.append(d[d >= 0])
        if not places:
            return np.empty(0, np.int64)
        return np.concatenate(places)[np.argsort(np.concatenate(differ), kind="stable")]


def near_between(a: Block, b: Block, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Which texts of a and of b may be similar to one of the other block that is of another group. a may be b."""
    of_a, of_b = np.zeros(len(a.nos), bool), np.zeros(len(b.nos), bool)
    for i in range(len(a.nos)):
        found = b.near(a, i, similarity)
        of_a[i] |= len(found) > 0
        of_b[found] = True
    return (of_a | of_b, of_a | of_b) if a is b else (of_a, of_b)


def links_between(a: Block, b: Block, similarity: float) -> list[tuple[int, int]]:
    """Pairs of numbers, one of each block, that join all sets of a and b which are similar and not of one group yet. a may be b."""
    out = []
    for i in range(len(a.nos)):
        left = b.near(a, i, similarity)
        while len(left):
            j, left = left[0], left[1:]
            common = len(np.intersect1d(a.sets[i], b.sets[j], assume_unique=True))
            if common >= similarity * (a.size[i] + b.size[j] - common) - 1e-9:
                out.append((a.nos[i], b.nos[j]))
                old, new = b.label[j], a.label[i]
                for block in {id(a): a, id(b): b}.values():
                    block.label[block.label == old] = new
                left = left[b.label[left] != new]
    return out


def _meetings(batches: Iterator[pd.DataFrame], value: str) -> Iterator[tuple[tuple, dict]]:
    """Rows in the order of key, i, j, block -> (key, i, j) and, by block, the rows' no, root, n, met and value, as lists."""
    at, held = None, {}
    for batch in batches:
        for k, i, j, block, no, root, n, met, v in zip(batch.key, batch.i, batch.j, batch.block, batch.no, batch.root, batch.n, batch.met, batch[value], strict=True):
            if (k, i, j) != at:
                if held:
                    yield at, held
                at, held = (k, i, j), {}
            for column, x in zip(held.setdefault(block, ([], [], [], [], [])), (no, root, n, met, np.asarray(v)), strict=True):
                column.append(x)
    if held:
        yield at, held


def _linked_runs(rows: DataFrame, sketches: DataFrame, texts: DataFrame, named: DataFrame, words: int, similarity: float) -> DataFrame:
    """rows: (key, no, n, root, met), root being the group that the text is known to be of, and texts of one met having been compared before; sketches: (no, sketch); texts: (id,
    text); named: (no, id). Links (a, b) that join all texts of one key that are similar and not yet of one group.

    A key's run is dealt by a hash into blocks, and every two of them, and each one with itself, meet in a task of
    their own; so every pair of a run is compared, however long it is, and a task holds two blocks. They meet with
    their sketches first. Only texts that these leave another one for meet again with their sets. Runs of one group
    need no comparing, and of runs, or what is left of them, with the same texts one is enough.
    """
    h = lambda seed: F.bit_xor(F.xxhash64("no", F.lit(seed)))
    runs = rows.groupBy("key").agg(F.count("no").alias("c"), F.sum("n").alias("words"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("met").alias("first"), F.max("met").alias("last"), h(1).alias("x"), h(2).alias("y"))
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("words") / BLOCK_SHINGLES, F.lit(1.0))).cast("int")
    runs = runs.filter("lo < hi and first < last").groupBy("c", "x", "y").agg(F.min("key").alias("key"), F.first(blocks).alias("blocks"))
    placed = rows.select("key", "no", "n", "root", "met").join(runs.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    met = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, "block").alias("i"), F.greatest(x, "block").alias("j")))
    pairs = placed.join(sketches, "no").select("*", F.explode(met).alias("m")).select("key", "m.i", "m.j", "block", "no", "root", "n", "met", "sketch")
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much to do: not to be merged into fewer
    dealt = lambda df: df.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "no")

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (k, i, j), held in _meetings(batches, "sketch"):
            if len(held) == 1 + (i != j):
                made = [Block(*held[b]) for b in sorted(held)]
                for x, which, b in zip(made, near_between(made[0], made[-1], similarity), sorted(held), strict=False):
                    at = np.flatnonzero(which)
                    yield pd.DataFrame({"key": k, "i": i, "j": j, "block": b, "no": np.array(x.nos, np.int64)[at], "root": x.label[at], "n": x.size[at], "met": x.met[at]})

    left = durable(dealt(pairs).mapInPandas(near, "key long, i int, j int, block int, no long, root long, n long, met long"))
    alike = left.groupBy("key", "i", "j").agg(F.count("no").alias("c"), h(1).alias("x"), h(2).alias("y")).groupBy("c", "x", "y").agg(F.min(F.struct("key", "i", "j")).alias("m")).select("m.*")
    listed = durable(shingle_sets(texts, left.select("no").distinct().join(named, "no"), words))

    def linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, i, j), held in _meetings(batches, "s"):
            if len(held) == 1 + (i != j):
                made = [Block.of_sets(nos, roots, [s.view(np.uint32) for s in sets]) for nos, roots, _, _, sets in (held[b] for b in sorted(held))]
                yield pd.DataFrame(links_between(made[0], made[-1], similarity), columns=["a", "b"])

    found = dealt(left.join(alike, ["key", "i", "j"]).join(listed, "no")).mapInPandas(linked, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _rooted(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """rows: (key, no, n). Those of keys whose texts are not all of one group yet, with their groups."""
    rooted = rows.join(connected_components(edges).withColumnRenamed("node", "no"), "no", "left").select("key", "no", "n", F.coalesce("root", "no").alias("root"))
    still = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("no").alias("c")).filter("lo < hi").select("key", "c")
    return durable(rooted.join(still, "key"))


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(text_key, root): for every distinct text (by MD5), the number that stands for its group.

    Texts that share one of the first shingles of their orders (see prefix) are candidates, which leaves out no pair
    that is similar enough. Bounds by size and place prune them, then the sketches, by pigeonring before the full count
    of bits; the Jaccard similarity of the sets of word shingles decides. Where very many texts share a key, a text is
    checked against the NEAREST of the next WINDOW ones. Texts for which pairs were passed over are then compared
    under their longest key, and under all other keys whose texts are not one group by then, block against block;
    only what joins them leaves the task. So no pairs of a large group are ever listed, and none is left out.

    Texts without words, null or not, are one group; texts of fewer words than a shingle are compared whole. Long
    texts are handled whole. An empty table gives an empty one.
    """
    key = F.md5(F.coalesce("text", F.lit("")))
    texts = docs.select(key.alias("id"), F.coalesce("text", F.lit("")).alias("text"))

    common, seen = _common_shingles(docs, texts, words)

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in slices([len(t) // 6 + 1 for t in batch.text], BATCH_WORDS):
                part = batch.iloc[a:b]
                own = shingle_hashes(list(part.text), words)
                sets = [short(h) for h in own]
                yield pd.DataFrame({"id": part.id.array, "n": [len(s) for s in sets], "sketch": [sketch(s) for s in sets], "keys": [prefix(h, similarity, common, seen).view(np.int64) for h in own]})

    each = texts.mapInPandas(prefixes, "id string, n long, sketch array<long>, keys array<long>").groupBy("id").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "keys")])
    every = durable(each.withColumn("no", F.monotonically_increasing_id()))
    found = durable(_candidates(every, similarity))
    pairs = durable(_near_by_sketch(found.filter("b is not null").select("a", "b"), every, similarity))
    named = every.select("no", "id")
    needed = durable(pairs.select(F.col("a").alias("no")).union(pairs.select(F.col("b").alias("no"))).distinct().join(named, "no"))
    edges = linking_pairs(durable(shingle_sets(texts, needed, words)), pairs, similarity)
    again = found.filter("b is null").select("key", F.col("a").alias("no"))
    if again.limit(1).count():
        runs = lambda rows: _linked_runs(rows, every.select("no", "sketch"), texts, named, words, similarity)
        rows = _rooted(every.select("no", "n").join(again, "no"), edges)
        longest = durable(rows.groupBy("no").agg(F.max(F.struct("c", "key"))["key"].alias("met")))
        edges = durable(edges.union(runs(rows.join(longest.withColumnRenamed("met", "key"), ["no", "key"]).withColumn("met", F.col("no")))))
        edges = durable(edges.union(runs(_rooted(rows.select("key", "no", "n"), edges).join(longest, "no"))))
    linked = connected_components(edges)
    return named.join(linked.withColumnRenamed("node", "no"), "no", "left").select(F.col("id").alias("text_key"), F.coalesce("root", "no").alias("root"))


def drop_near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with their columns, that stand for their group of near copies: the smallest doc_id stays.

    Null ids come last. Of rows with equal doc_id and text any one stays; rows with equal doc_ids and different texts
    of one group are told apart by their texts. Null and empty texts are one group. Columns may have any names; an
    empty table gives an empty one.

    Only rows that go, and rows that come several times, are exchanged with their texts.
    """
    key = F.md5(F.coalesce("text", F.lit("")))
    groups = near_copies(docs, words, similarity)
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"))
    ids = docs.select(key.alias("text_key"), place.alias("place")).groupBy("text_key", "place").agg(F.count(F.lit(1)).alias("rows"))
    placed = durable(ids.join(groups, "text_key"))
    # Written before the join: so that a large group's texts are a join key that adaptive execution can split.
    first = durable(placed.groupBy("root").agg(F.min(F.struct("place", "text_key")).alias("x"), F.sum("rows").alias("all")).filter(F.col("all") > 1))
    name = lambda text_key, doc_id: F.concat(text_key, F.lit("|"), F.coalesce(doc_id.cast("string"), F.lit("\\N")))
    own = free_name(docs, "__own")
    stays = F.struct("place", "text_key") == F.col("x")
    decided = durable(placed.join(first, "root").filter(~stays | (F.col("rows") > 1)).select(name(F.col("text_key"), F.col("place.i")).alias(own), stays.alias("stays")))
    gone, several = decided.filter(~F.col("stays")).select(own), decided.filter("stays").select(own)
    some, rest = split_by(docs.withColumn(own, name(key, F.col("doc_id"))), own, members(decided, own))
    left = some.join(gone, own, "left_anti")
    once = left.join(several, own, "left_semi").dropDuplicates([own])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return rest.select(*columns).union(left.join(several, own, "left_anti").select(*columns)).union(once.select(*columns))
