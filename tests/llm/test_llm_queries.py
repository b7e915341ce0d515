"""The registered queries against their SQL, or brute force, on the small tables."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import struct
import zlib

import numpy as np
import pytest
import xxhash
from conftest import same_rows

from wavelake.llm import packing, queries, simhash
from wavelake.llm.common import fold

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    same_rows(QUERIES[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df())


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def test_op1_targets_are_met(spark, sf_dir, duck):
    got = QUERIES["op1_mix_sources"](spark, sf_dir).toPandas()
    assert (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    got["source"] = got.doc_id.map(dict(duck.execute("SELECT doc_id, source FROM documents").fetchall()))
    by = got.groupby("source").agg(size=("size", "sum"), told=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by.told).all() and by.target.sum() == pytest.approx(by["size"].sum()) and ((by.taken - by.target).abs() <= 64).all()
    again = QUERIES["op1_mix_sources"](spark, sf_dir).toPandas()
    same_rows(got.drop(columns="source"), again)


def brute_scores(training: list[list[str]], asked: list[list[str]]) -> list[float]:
    """log10 probabilities by the smoothing that the module tells, order 3, counted plainly."""
    one, two, three, above2, above3 = (collections.Counter() for _ in range(5))
    for w in training:
        one.update(w)
        above2.update(["start", *w[:-1]])
        two.update(zip(["start", *w], w, strict=False))
        above3.update(zip(["start", *w], w[:-1], strict=False))
        three.update(zip(["start", *w], w, w[1:], strict=False))
    n, v = sum(one.values()), len(one)
    p1 = lambda w: (one[w] + 0.5) / (n + 0.5 * (v + 1))

    def p(count: int, context: int, order: int, lower: float) -> float:
        if order == 2:
            m = 4.0 * max(context, 1) ** 0.9
            return (count + m * lower) / (context + m)
        left = 1.0 if not context else 0.8 if context == 1 else 0.4 * (2 / context) ** 0.2
        return (1 - left) * count / max(context, 1) + left * lower

    out = []
    for w in asked:
        padded = ["start", *w]
        total = 0.0
        for i, x in enumerate(w):
            q = p(two[padded[i], x], above2[padded[i]], 2, p1(x))
            total += math.log10(q if i == 0 else p(three[padded[i - 1], padded[i], x], above3[padded[i - 1], padded[i]], 3, q))
        out.append(total)
    return out


def test_op3_equals_brute_force(spark, sf_dir, texts):
    tokens = {k: [*fold(t), "end"] for k, t in texts.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    training = [w for k, w in tokens.items() if not held[k]]
    one = collections.Counter(x for w in training for x in w)
    n, v = sum(one.values()), len(one)
    score = dict(zip(tokens, brute_scores(training, list(tokens.values())), strict=True))
    better = total = 0.0
    got = QUERIES["op3_lm_scores"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        w = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(one[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
        assert abs(r.score - score[r.doc_id]) <= 0.001 * len(w)
        if r.held_out:
            better, total = better + r.score, total + r.base_score
    assert better > 0.95 * total


def test_op3_scores_texts_outside_the_corpus_by_its_files(spark, sf_dir, texts):
    from wavelake.llm import scoring

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, _ = scoring.learned_model(docs)
    words = fold(max(texts.values(), key=len))[:50]
    others = [b" ".join(words), b" ".join(words[::-1]), b"never seen zzz " + words[0], b""]
    asked = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(others)], "doc_id long, text string")
    got = [r.score for r in scoring.score_texts(asked, model).orderBy("doc_id").collect()]
    training = [[*fold(t), "end"] for k, t in texts.items() if zlib.crc32(str(k).encode()) % 5 != 1]
    assert got == pytest.approx(brute_scores(training, [[*t.split(), "end"] for t in others]), abs=0.05)


def test_op5_is_a_permutation(spark, sf_dir, texts):
    got = QUERIES["op5_shard"](spark, sf_dir).toPandas()
    counts = np.bincount(got["shard"], minlength=24)
    assert sorted(got.doc_id) == sorted(texts) and counts.max() - counts.min() <= 1 and (got.law == "rows").all() and got.grown_shard.isna().all()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    for r in got.itertuples():
        raw = texts[r.doc_id].encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)


def brute_print(text: str) -> int:
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in simhash.shingles(text.encode().lower().split(), 3)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op7_equals_brute_force(spark, sf_dir, texts):
    got = {r.doc_id: r for r in QUERIES["op7_simhash_dedup"](spark, sf_dir).collect()}
    assert {k: int(r.fingerprint, 16) for k, r in got.items()} == {k: brute_print(t) for k, t in texts.items()}
    root = {k: k for k in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and (int(got[a].fingerprint, 16) ^ int(got[b].fingerprint, 16)).bit_count() <= 2:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    assert {k: r.component_id for k, r in got.items()} == root


def test_op9_round_trip(spark, sf_dir, texts):
    for r in QUERIES["op9_media_columns"](spark, sf_dir).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        stored = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        assert r.tail_crc32 == zlib.crc32(payload[-16:]) and r.media_bytes == len(stored) and r.media_sha256 == hashlib.sha256(stored).hexdigest()
        inside = re.findall(rb"%PDF-\d.*?startxref.*?%%EOF", payload, re.DOTALL)
        assert inside or r.feature == f"application/octet-stream>audio/wav+{len(stored)}"


def test_op10_packs_everything_without_conflict(spark, sf_dir, duck, texts):
    source = dict(duck.execute("SELECT doc_id, source FROM documents").fetchall())
    got = QUERIES["op10_best_fit_packing"](spark, sf_dir).toPandas()
    words = got.groupby("doc_id").words.sum()
    assert {k: int(v) for k, v in words.items()} == {k: len(t.encode().split()) for k, t in texts.items()}
    for _, g in got[got.words > 0].groupby(["pack", "bin"]):
        assert g.words.sum() <= packing.Packing().capacity
        docs = list(g.doc_id)
        assert len({texts[d] for d in docs}) == len(docs) or len(docs) == 1
        assert max(collections.Counter(source[d] for d in docs).values()) <= 2
        ends = sorted(zip(g.offset, g.offset + g.words, strict=True))
        assert all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_pipeline_stages(spark, sf_dir, texts):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id for r in QUERIES["op8_quality_rules"](spark, sf_dir).filter("kept").collect()}
    from wavelake.llm.common import written

    stages = dict(corpus_pipeline.STAGES)
    good = written(stages["quality_rules"](spark, docs, sf_dir))
    assert {r.doc_id for r in good.collect()} == kept and good.columns == columns
    alone = written(stages["near_copies"](spark, good, sf_dir))
    ids = [r.doc_id for r in alone.collect()]
    sets = {k: set(simhash.shingles(fold(texts[k]), 5)) for k in kept}
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    assert len(ids) == len(set(ids)) and alone.columns == columns
    gone = kept - set(ids)
    assert all(any(similar(g, k) for k in kept if k < g) for g in gone)
    assert not any(similar(a, b) for a in ids for b in ids if a < b)
    mixed = written(stages["mix_sources"](spark, alone, sf_dir))
    assert mixed.columns == columns and set(r.doc_id for r in mixed.collect()) <= set(ids)
    packed = stages["best_fit_packing"](spark, mixed, sf_dir).toPandas()
    assert packed.words.sum() == sum(len(r.text.encode().split()) for r in mixed.collect())
    assert corpus_pipeline.ORACLE_SQL is None and corpus_pipeline.run(spark, sf_dir).count() == len(packed)
