"""Quality rules: how much of a text repeats itself.

Rolling hashes over word identifiers find, in numpy and for a whole Arrow batch at once, the n-word windows
that a text holds twice or more; the characters of the words inside such windows, and of lines that an
earlier line equals, are measured against all characters in words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WHITESPACE, Interned, id_text, mix64, slices, utf8, with_id_of

#: Highest share, in percent, of a text's word characters inside repeated n-word windows. A header line that a short
#: page shows twice covers up to 30 percent and is no fault; text that loops covers most of itself.
REPEAT_LIMITS = {5: 40, 6: 38, 7: 36, 8: 34, 9: 32, 10: 30}
#: Highest share, in percent, of lines and of word characters in lines that an earlier line equals.
LINE_LIMIT, LINE_CHARS_LIMIT = 40, 35
BASE_WINDOW, BASE_LIMIT, BASE_WORDS = 8, 30, 20
SYMBOLS = b"#*$%&|<>"
BATCH_WORDS = 400_000
_STEP = U64(0x9E3779B97F4A7C15)

COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def _word_chars(text: str) -> int:
    return len(text) - sum(text.count(c) for c in WHITESPACE)


def _covered(rolled: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that its text holds twice or more. rolled: the window's hash by its first word."""
    size = len(doc)
    inside = np.flatnonzero(doc[: len(rolled)] == doc[n - 1 :])
    key = mix64(rolled[inside] + mix64(doc[inside].astype(U64) + U64(1)))
    order = np.argsort(key)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    twice = np.zeros(len(inside), bool)
    twice[order[same]] = twice[order[same + 1]] = True
    edge = np.zeros(size + 1, np.int32)
    starts = inside[twice]
    edge[starts] += 1
    np.subtract.at(edge, starts + n, 1)
    return np.cumsum(edge[:size]) > 0


def measure(texts: list[str]) -> pd.DataFrame:
    """The measures of each text, as in COLUMNS, with repeated_chars_N by window length and dup_line_chars."""
    known, ids, counts, rows = Interned(), [], [], []
    for text in texts:
        raw = utf8(text)
        words = raw.split()
        ids.extend(map(known.__getitem__, words))
        counts.append(len(words))
        lines = [x for x in text.split("\n") if x.strip(WHITESPACE)]
        seen: set[str] = set()
        again = [x for x in lines if x in seen or seen.add(x)] if len(lines) > len(set(lines)) else []
        rows.append((len(words), _word_chars(text), len(raw) - len(raw.translate(None, SYMBOLS)), len(again), len(lines), sum(map(_word_chars, again))))
    out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "dup_line_chars"]).astype("int64")
    at = np.array(ids, np.int64)
    doc = np.repeat(np.arange(len(texts)), counts)
    hashes = known.hashes()[at] if len(at) else np.empty(0, U64)
    chars = np.array([len(w.decode("utf-8", "surrogatepass")) for w in known.words], np.int64)[at] if len(at) else np.empty(0, np.int64)
    rolled = hashes
    out["n_repeat_words"] = 0
    for n in range(2, max(REPEAT_LIMITS) + 1):
        rolled = rolled[:-1] * _STEP + hashes[n - 1 :]
        if n in REPEAT_LIMITS:
            hit = _covered(rolled, doc, n) if len(rolled) else np.zeros(len(doc), bool)
            out[f"repeated_chars_{n}"] = np.bincount(doc[hit], weights=chars[hit], minlength=len(texts)).astype("int64")
            if n == BASE_WINDOW:
                out["n_repeat_words"] = np.bincount(doc[hit], minlength=len(texts))
    out["base_failed"] = (out.n_words < BASE_WORDS) | (100 * out.n_repeat_words > BASE_LIMIT * out.n_words)
    bad = (100 * out.n_dup_lines > LINE_LIMIT * out.n_lines) | (100 * out.dup_line_chars > LINE_CHARS_LIMIT * out.word_chars)
    for n, most in REPEAT_LIMITS.items():
        bad |= 100 * out[f"repeated_chars_{n}"] > most * out.word_chars
    out["kept"] = ~out.base_failed & ~bad
    return out


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(",")]


def repetition_rules(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id and COLUMNS.

    Null and empty texts have no words, so they fail the base rule; a null doc_id stays null; repeated rows
    are judged one by one; a share that equals its limit passes; other columns are not read, whatever they are called.
    An empty table gives an empty one. Texts are handled
    whole, in groups of about BATCH_WORDS words (a longer text alone), so memory follows the longest text.
    """

    def rules(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for a, b in slices([len(t) // 6 + 1 for t in texts], BATCH_WORDS):
                out = measure(texts[a:b])[_names(COLUMNS)]
                out.insert(0, "doc_id", batch["doc_id"].iloc[a:b].array)
                yield out

    return with_id_of(docs.select(id_text(docs).alias("doc_id"), "text").mapInPandas(rules, f"doc_id string, {COLUMNS}"), docs)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text passes both the base rule and the repetition rules.

    Null and empty texts fail; long texts are judged whole; repeated rows are judged one by one, so all stay or all go;
    columns may have any names; an empty table gives an empty one.
    """

    @F.pandas_udf("boolean")
    def good(text: pd.Series) -> pd.Series:
        texts = [t if isinstance(t, str) else "" for t in text]
        parts = [measure(texts[a:b])["kept"] for a, b in slices([len(t) // 6 + 1 for t in texts], BATCH_WORDS)]
        return pd.concat(parts, ignore_index=True) if parts else pd.Series([], dtype=bool)

    return docs.filter(good(F.col("text")))


def repetition_sql() -> str:
    """DuckDB SQL for repetition_rules over documents."""
    words = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
    per_n = ",\n".join(
        f"""g{n} AS (SELECT k, i, list_aggregate(w[i:i+{n - 1}], 'string_agg', ' ') AS g FROM starts WHERE i + {n - 1} <= len(w)),
d{n} AS (SELECT k, i FROM g{n} QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
c{n} AS (SELECT k, count(*) AS nw, sum(length(w[p])) AS nc FROM (SELECT DISTINCT d.k, d.i + o.o AS p FROM d{n} d, range({n}) o(o)) JOIN doc USING (k) GROUP BY k)"""
        for n in REPEAT_LIMITS
    )
    joins = " ".join(f"LEFT JOIN c{n} ON c{n}.k = doc.k" for n in REPEAT_LIMITS)
    verdict = " AND ".join(f"100 * coalesce(c{n}.nc, 0) <= {most} * word_chars" for n, most in REPEAT_LIMITS.items())
    return rf"""
WITH doc AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, {words} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
starts AS (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
{per_n},
line AS (SELECT k, l, count(*) - 1 AS again, length(regexp_replace(l, '[\x20\x09-\x0D]', '', 'g')) AS nc FROM (SELECT k, unnest(lines) AS l FROM doc) GROUP BY k, l),
lined AS (SELECT k, sum(again) AS dup, sum(again * nc) AS dup_chars FROM line GROUP BY k),
base AS (SELECT doc.k, doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(dup_chars, 0) AS dup_chars, len(lines) AS n_lines
  FROM doc LEFT JOIN lined USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, coalesce(c8.nw, 0)::BIGINT AS n_repeat_words,
  (n_words < 20 OR 100 * coalesce(c8.nw, 0) > 30 * n_words) AS base_failed,
  (n_words >= 20 AND 100 * coalesce(c8.nw, 0) <= 30 * n_words AND {verdict}
   AND 100 * n_dup_lines <= {LINE_LIMIT} * n_lines AND 100 * dup_chars <= {LINE_CHARS_LIMIT} * word_chars) AS kept
FROM base AS doc {joins}"""
