"""Queries over media bytes: headers by expressions, containers built and read back, tags, checksums, codecs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import headers as h
from ..registry import query
from ..sources import checksums, flac, mp4, mpeg, ogg, opus, readers
from .views import BYTES_SQL, RATE, clips, pcm_bytes, table


def _b(i: int) -> str:
    return f"('0x' || h[{2 * i + 1}:{2 * i + 2}])::INT"


def _list(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


_MODES = ("silk",) * 12 + ("hybrid",) * 4 + ("celt",) * 16
_BANDS = ("narrow",) * 4 + ("medium",) * 4 + ("wide",) * 4 + ("superwide",) * 2 + ("full",) * 2 + ("narrow",) * 4 + ("wide",) * 4 + ("superwide",) * 4 + ("full",) * 4
_MICROS = (10000, 20000, 40000, 60000) * 3 + (10000, 20000) * 2 + (2500, 5000, 10000, 20000) * 4


@query(
    f"""WITH {BYTES_SQL}, t AS (SELECT id, h, {_b(0)} >> 3 AS c, {_b(0)} AS b FROM bytes WHERE len(h) > 2)
SELECT id, {_list(_MODES)}[c + 1] AS mode, {_list(_BANDS)}[c + 1] AS bandwidth, {_list(_MICROS)}[c + 1] AS frame_us, ((b >> 2) & 1) + 1 AS channels, b & 3 AS code,
  CASE b & 3 WHEN 0 THEN 1 WHEN 3 THEN {_b(1)} & 63 ELSE 2 END AS frames FROM t"""
)
def opus_toc(spark: SparkSession, d: str) -> DataFrame:
    return pcm_bytes(spark, d).filter(F.octet_length("raw") > 1).select("id", h.opus_toc(F.col("raw")).alias("t")).select("id", "t.*")


def _header_bytes(spark: SparkSession, d: str, first: str) -> DataFrame:
    """Every document's bytes behind the first byte of a sync word, with the high bits of the second set: varied headers."""
    second = F.unhex(F.lpad(F.hex(h.byte(F.col("raw"), 1).bitwiseOR(F.lit(int(first, 16)))), 2, "0"))
    return pcm_bytes(spark, d).filter(F.octet_length("raw") >= 8).select("id", F.concat(F.unhex(F.lit("FF")), second, F.substring("raw", 3, 8)).alias("raw"))


def _header_sql(first: str) -> str:
    return f"{BYTES_SQL}, f AS (SELECT id, 'FF' || lpad(upper(to_hex(('0x' || h[3:4])::INT | {int(first, 16)})), 2, '0') || h[5:20] AS h FROM bytes WHERE len(h) >= 16)"


@query(
    f"""WITH {_header_sql("E0")}, x AS (SELECT id, ({_b(1)} >> 3) & 3 AS v, ({_b(1)} >> 1) & 3 AS l, {_b(2)} >> 4 AS r, ({_b(2)} >> 2) & 3 AS f, {_b(3)} >> 6 AS m FROM f)
SELECT id, CASE v WHEN 3 THEN '1' WHEN 2 THEN '2' ELSE '2.5' END AS version, 4 - l AS layer,
  1000 * (CASE WHEN v = 3 AND l = 3 THEN {_list(mpeg.BIT_RATES["1-1"])}[r] WHEN v = 3 AND l = 2 THEN {_list(mpeg.BIT_RATES["1-2"])}[r] WHEN v = 3 THEN {_list(mpeg.BIT_RATES["1-3"])}[r]
    WHEN l = 3 THEN {_list(mpeg.BIT_RATES["2-1"])}[r] ELSE {_list(mpeg.BIT_RATES["2-2"])}[r] END) AS bit_rate,
  CASE v WHEN 3 THEN {_list(mpeg.SAMPLE_RATES["1"])}[f + 1] WHEN 2 THEN {_list(mpeg.SAMPLE_RATES["2"])}[f + 1] ELSE {_list(mpeg.SAMPLE_RATES["2.5"])}[f + 1] END AS sample_rate,
  CASE WHEN m = 3 THEN 1 ELSE 2 END AS channels, CASE WHEN l = 3 THEN 384 WHEN l = 2 OR v = 3 THEN 1152 ELSE 576 END AS samples
FROM x WHERE v <> 1 AND l <> 0 AND r NOT IN (0, 15) AND f <> 3"""
)
def mp3_header(spark: SparkSession, d: str) -> DataFrame:
    return _header_bytes(spark, d, "E0").select("id", h.mpeg_frame(F.col("raw")).alias("t")).filter("t is not null").select("id", "t.*")


@query(
    f"""WITH {_header_sql("F0")}, x AS (SELECT id, {_b(1)} AS b1, {_b(2)} AS b2, {_b(3)} AS b3, {_b(4)} AS b4, {_b(5)} AS b5 FROM f),
y AS (SELECT *, (b2 >> 2) & 15 AS c, (b3 & 3) * 2048 + b4 * 8 + (b5 >> 5) AS size, CASE WHEN b1 & 1 = 1 THEN 7 ELSE 9 END AS header FROM x WHERE b1 & 246 = 240)
SELECT id, CASE WHEN b1 & 8 = 8 THEN 2 ELSE 4 END AS mpeg, b2 >> 6 AS profile, {_list(mpeg.ADTS_RATES)}[c + 1] AS sample_rate, (b2 & 1) * 4 + (b3 >> 6) AS channels, header, size FROM y WHERE c < 13 AND size >= header"""
)
def adts_header(spark: SparkSession, d: str) -> DataFrame:
    return _header_bytes(spark, d, "F0").select("id", h.adts_frame(F.col("raw")).alias("t")).filter("t is not null").select("id", "t.*")


# Tags ------------------------------------------------------------------------------------------------------------


@query("SELECT conv_id, upper(role) AS key, count(*) AS n, first(text ORDER BY turn) AS value, md5(string_agg(text, chr(0) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id, upper(role)")
def tags_multimap(spark: SparkSession, d: str) -> DataFrame:
    """Roles as keys in upper case, texts as their values in order: a map of arrays, looked up."""
    values = F.array_sort(F.collect_list(F.struct("turn", "text"))).getField("text")
    keyed = table(spark, d, "conversations").groupBy("conv_id", F.upper("role").alias("key")).agg(values.alias("values"))
    maps = keyed.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "values"))).alias("tags"))
    one = maps.select("conv_id", F.explode("tags").alias("key", "values"))
    return one.select("conv_id", "key", F.size("values").cast("long").alias("n"), F.element_at("values", 1).alias("value"), F.md5(F.array_join("values", "\0")).alias("digest"))


@query(
    """WITH a AS (SELECT conv_id, role AS key, min(text) AS value FROM conversations GROUP BY 1, 2), b AS (SELECT conv_id, role AS key, max(text) AS value FROM conversations WHERE role <> 'user' GROUP BY 1, 2)
SELECT a.conv_id, a.key, coalesce(b.value, a.value) AS value FROM a LEFT JOIN b USING (conv_id, key)"""
)
def tags_override(spark: SparkSession, d: str) -> DataFrame:
    """One set of tags over another, key by key: the later one's keys are dropped from the earlier before they are joined."""
    rows = table(spark, d, "conversations")
    as_map = lambda df, f: df.groupBy("conv_id", "role").agg(f("text").alias("v")).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "v"))).alias("m"))
    first, over = as_map(rows, F.min).withColumnRenamed("m", "a"), as_map(rows.filter("role <> 'user'"), F.max).withColumnRenamed("m", "b")
    empty = F.create_map().cast("map<string,string>")
    both = first.join(over, "conv_id", "left").withColumn("b", F.coalesce("b", empty))
    kept = F.map_filter("a", lambda k, v: ~F.map_contains_key("b", k))
    return both.select("conv_id", F.explode(F.map_concat(kept, "b")).alias("key", "value"))


# Containers built here and read back -----------------------------------------------------------------------------


def _tracks(spark: SparkSession, d: str) -> DataFrame:
    tags = F.create_map(F.lit("TITLE"), F.array(F.concat(F.lit("clip "), F.col("clip_id").cast("string"))), F.lit("GENRE"), F.array(F.col("label").cast("string")))
    return clips(spark, d).select(F.concat(F.lit("c"), F.col("clip_id").cast("string")).alias("path"), F.lit(RATE).alias("sample_rate"), (F.col("clip_id") % 2 + 1).cast("int").alias("channels"), "data", tags.alias("tags"))


_HEADER_SQL = """SELECT 'c' || vec_id AS path, 'wav' AS format, 8000 AS sample_rate, (vec_id % 2 + 1)::INT AS channels, 16 AS bits, 's16' AS sample_format, 64 // (vec_id % 2 + 1) AS frames,
 8000 * 16 * (vec_id % 2 + 1)::INT AS bit_rate, 'clip ' || vec_id AS title, label::VARCHAR AS genre FROM embeddings"""


@query(_HEADER_SQL)
def wav_headers(spark: SparkSession, d: str) -> DataFrame:
    """Clips written as WAV files and read by their headers only."""
    files = readers.to_wav(_tracks(spark, d)).select("path", "content")
    tag = lambda k: F.element_at(F.element_at("tags", k), 1)
    return readers.headers(files).select("path", "format", "sample_rate", "channels", "bits", "sample_format", "frames", "bit_rate", tag("TITLE").alias("title"), tag("GENRE").alias("genre"))


@query(
    """SELECT path, (i - 1)::INT AS pos, round(trunc(greatest(least(x[i]::DOUBLE, 1::DOUBLE), -1::DOUBLE) * 32767) / 32768::DOUBLE, 6) + 0.0::DOUBLE AS sample
FROM (SELECT 'c' || vec_id AS path, embedding AS x, unnest(range(1, 65)) AS i FROM embeddings)"""
)
def wav_samples(spark: SparkSession, d: str) -> DataFrame:
    back = readers.samples(readers.to_wav(_tracks(spark, d)).select("path", "content"))
    return back.select("path", F.posexplode("data").alias("pos", "x")).select("path", "pos", (F.round("x", 6) + F.lit(0.0)).alias("sample"))


@query(
    """SELECT path, (i - 1)::INT AS pos, round(round(x[i]::DOUBLE * 32767) / 32767::DOUBLE, 6) + 0.0::DOUBLE AS sample FROM (SELECT 'c' || vec_id AS path, embedding AS x, unnest(range(1, 65)) AS i FROM embeddings)"""
)
def flac_samples(spark: SparkSession, d: str) -> DataFrame:
    """Clips encoded losslessly as FLAC and decoded, their MD5 checked."""
    back = readers.samples(readers.to_flac(_tracks(spark, d)).select("path", "content"))
    return back.select("path", F.posexplode("data").alias("pos", "x")).select("path", "pos", (F.round("x", 6) + F.lit(0.0)).alias("sample"))


@query(
    """SELECT path, count(*) AS n, round(sum(round(x::DOUBLE * 32767) / 32767::DOUBLE), 6) + 0.0::DOUBLE AS total FROM (SELECT 'c' || vec_id AS path, unnest(embedding) AS x FROM embeddings) GROUP BY path"""
)
def ogg_flac_samples(spark: SparkSession, d: str) -> DataFrame:
    back = readers.samples(readers.to_flac(_tracks(spark, d), in_ogg=True).select("path", "content"))
    total = F.aggregate("data", F.lit(0.0), lambda a, x: a + x)
    return back.select("path", F.size("data").cast("long").alias("n"), (F.round(total, 6) + F.lit(0.0)).alias("total"))


@query(
    """WITH keys(role, key) AS (VALUES ('user', 'PROMPT'), ('assistant', 'ANSWER')) SELECT conv_id, turn, coalesce(key, 'TAG:' || role) AS key FROM conversations LEFT JOIN keys USING (role)"""
)
def tag_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Keys looked up in a small dictionary; unknown ones keep their name behind a prefix."""
    keys = spark.createDataFrame([("user", "PROMPT"), ("assistant", "ANSWER")], "role string, key string")
    return table(spark, d, "conversations").join(F.broadcast(keys), "role", "left").select("conv_id", "turn", F.coalesce("key", F.concat(F.lit("TAG:"), F.col("role"))).alias("key"))


@query("SELECT doc_id AS id, octet_length(encode(text))::BIGINT AS n_bytes, md5(text) AS digest FROM documents")
def ogg_packets(spark: SparkSession, d: str) -> DataFrame:
    """Every document's bytes as packets of 1000 bytes in a logical stream, two streams a file, muxed, demuxed and joined where the file is.

    The stream is told by its codec, so no id is too large, and rows of one id stay apart. A null text has no file.
    """

    def one(t: str) -> list[bytes]:
        raw = t.encode()
        parts = [b"OpusHead"] + [raw[i : i + 1000] for i in range(0, len(raw), 1000)]
        content = ogg.mux([(p, k) for k, p in enumerate(parts)], 1) + ogg.mux([(b"\x7fFLAC", 0)], 2)
        return next(s["packets"] for s in readers.ogg_streams_of(content) if s["codec"] == "opus")

    @F.pandas_udf("array<binary>")
    def packets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from readers.sliced(batches, one)

    own = table(spark, d, "documents").select(F.col("doc_id").alias("id"), packets("text").alias("packets"))
    joined = own.select("id", F.unhex(F.array_join(F.transform(F.slice("packets", F.lit(2), F.size("packets")), F.hex), "")).alias("raw"))
    return joined.select("id", F.octet_length("raw").cast("long").alias("n_bytes"), F.md5("raw").alias("digest"))


def _built(spark: SparkSession, d: str) -> DataFrame:
    """A file of every kind per clip, and a damaged one."""

    @F.pandas_udf("array<struct<path:string,content:binary>>")
    def made(clip: pd.Series, data: pd.Series) -> pd.Series:
        def one(k: int, x: np.ndarray) -> list[dict]:
            units = [np.asarray(x, "<f8").tobytes()[i : i + 40 + k % 7] for i in range(0, 400, 40)]
            frame = bytes([0xFF, 0xFB, 0x90, 0x64]) + bytes(413)
            files = {
                "adts": b"\0junk" + b"".join(mpeg.build_adts(u, 44100, 2, guarded=k % 2 == 0) for u in units),
                "mp4": mp4.build(units, 44100, 2, tags=[("TITLE", f"t{k}"), ("ARTIST", "a")], per_chunk=1 + k % 4),
                "mp3": mpeg.build_id3v2([("TITLE", f"t{k}"), ("ARTIST", "ä")]) + frame * 2 + mpeg.build_id3v1("old", "old artist", track=3),
                "ogg": ogg.mux_opus([(u, 960) for u in units], k, 2, [("TITLE", f"t{k}")]),
                "bad": b"RIFF" + bytes(20),
            }
            return [{"path": f"{k}.{n}", "content": c} for n, c in files.items()]

        return pd.Series([one(int(k), x) for k, x in zip(clip, data, strict=True)])

    return clips(spark, d).select(F.explode(made("clip_id", "data")).alias("f")).select("f.path", "f.content")


@query(
    """WITH e AS (SELECT vec_id AS k FROM embeddings)
SELECT k || '.adts' AS path, 'adts' AS format, 44100 AS sample_rate, 2 AS channels, 10240 AS frames, NULL::VARCHAR AS title, false AS failed FROM e
UNION ALL SELECT k || '.mp4', 'mp4', 44100, 2, 10240, 't' || k, false FROM e
UNION ALL SELECT k || '.mp3', 'mp3', 44100, 2, NULL, 't' || k, false FROM e
UNION ALL SELECT k || '.ogg', 'ogg', 48000, 2, 9288, 't' || k, false FROM e
UNION ALL SELECT k || '.bad', 'wav', NULL, NULL, NULL, NULL, true FROM e"""
)
def container_headers(spark: SparkSession, d: str) -> DataFrame:
    found = readers.headers(_built(spark, d))
    return found.select("path", "format", "sample_rate", "channels", "frames", F.try_element_at(F.try_element_at("tags", F.lit("TITLE")), F.lit(1)).alias("title"), F.col("error").isNotNull().alias("failed"))


@query("""SELECT vec_id || '.' || f AS path, p::BIGINT AS packet_no, (40 + vec_id % 7)::INT AS size FROM embeddings, (VALUES ('adts'), ('mp4')) t(f), range(10) r(p)""")
def access_units(spark: SparkSession, d: str) -> DataFrame:
    """Access units of ADTS and MP4 files: as many, and as long, as were put in."""
    files = _built(spark, d).filter(F.col("path").endswith(".adts") | F.col("path").endswith(".mp4"))
    return readers.packets(files).select("path", "packet_no", F.octet_length("data").alias("size"))


@query()
def opus_packets(spark: SparkSession, d: str) -> DataFrame:
    """Frame sizes inside packets, and why a packet is broken."""
    return readers.opus_packets(pcm_bytes(spark, d).withColumnRenamed("raw", "data")).select("id", "opus.*")


def _crc_sql(width: int, poly: int, start: int = 0) -> tuple[str, str]:
    """The checksum of the list b of bytes, by folding (its first element is what the checksum starts from), and its table."""
    table, mask = f"[{', '.join(str(x) for x in checksums._table(width, poly))}]", (1 << width) - 1
    return f"list_reduce(list_concat([{start}::BIGINT], b), lambda r, x: xor((r << 8) & {mask}, t{width}x{poly}[xor(r >> {width - 8}, x) + 1]))", f"{table} AS t{width}x{poly}"


_SUMS = {"ogg": _crc_sql(32, 0x04C11DB7), "flac8": _crc_sql(8, 0x07), "flac16": _crc_sql(16, 0x8005), "adts": _crc_sql(16, 0x8005, 0xFFFF)}


@query(
    f"""WITH {BYTES_SQL}, tables AS (SELECT {", ".join(sorted({t for _, t in _SUMS.values()}))}), l AS (SELECT id, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT) AS b FROM bytes)
SELECT id, {", ".join(f"({c})::{'BIGINT' if k == 'ogg' else 'INT'} AS {k}" for k, (c, _) in _SUMS.items())} FROM l, tables"""
)
def byte_checksums(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("struct<ogg:long,flac8:int,flac16:int,adts:int>")
    def sums(raw: pd.Series) -> pd.DataFrame:
        f = (checksums.ogg_crc32, checksums.flac_crc8, checksums.flac_crc16, checksums.adts_crc16)
        return pd.DataFrame([[g(bytes(b)) for g in f] for b in raw], columns=["ogg", "flac8", "flac16", "adts"])

    return pcm_bytes(spark, d).select("id", sums("raw").alias("c")).select("id", "c.*")

