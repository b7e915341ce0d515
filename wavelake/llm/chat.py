"""Chat formatting: records of any known layout become canonical turns, then one marked and escaped text.

Each record's fingerprint is a hash of the nested field paths that it fills. Every layout is a declaration: the
paths it fills, and expressions that give its turns. The fingerprint picks the declaration, row by row, so one
table may mix prompts, instructions and message lists. All of it is built-in SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind, sums_before

TURNS = "array<struct<role:string,text:string>>"

#: The template, and what each control string's first character is written as inside texts.
OPEN, NEWLINE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROL = r"<(?=\|im_start\||\|im_end\||/?s>|/?INST>)"
BRACKET = r"\[(?=/?INST\])"
TRAINED_ROLE = "assistant"


def _turn(role: str, text: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), text.alias("text"))


def _messages(column: str, role: str, text: str) -> Column:
    return F.transform(F.col(column), lambda m: F.struct(m[role].alias("role"), m[text].alias("text")))


@dataclass(frozen=True)
class Layout:
    """paths: the nested field paths that a record of this layout fills; turns: its turns."""

    paths: tuple[str, ...]
    turns: Callable[[], Column]

    def fingerprint(self) -> Column:
        return F.xxhash64(F.lit("\n".join(sorted(self.paths))))


LAYOUTS = {
    "messages": Layout(("messages[].content", "messages[].role"), lambda: _messages("messages", "role", "content")),
    "conversations": Layout(("conversations[].from", "conversations[].value"), lambda: _messages("conversations", "from", "value")),
    "prompt": Layout(("completion", "prompt"), lambda: F.array(_turn("user", F.col("prompt")), _turn("assistant", F.col("completion")))),
    "system_prompt": Layout(
        ("completion", "prompt", "system"), lambda: F.array(_turn("system", F.col("system")), _turn("user", F.col("prompt")), _turn("assistant", F.col("completion")))
    ),
    "instruction": Layout(("instruction", "output"), lambda: F.array(_turn("user", F.col("instruction")), _turn("assistant", F.col("output")))),
    "instruction_input": Layout(
        ("input", "instruction", "output"),
        lambda: F.array(_turn("user", F.concat(F.col("instruction"), F.lit("\n\n"), F.col("input"))), _turn("assistant", F.col("output"))),
    ),
}


def _filled(records: DataFrame) -> Column:
    """The record's filled paths, sorted, a line each. Which paths can be filled is read from the schema."""
    known = {p for layout in LAYOUTS.values() for p in layout.paths}
    found: list[tuple[str, Column]] = []
    for field in records.schema.fields:
        if field.dataType.typeName() == "array" and field.dataType.elementType.typeName() == "struct":
            for inner in field.dataType.elementType.fieldNames():
                found.append((f"{field.name}[].{inner}", F.col(f"`{field.name}`").isNotNull()))
        else:
            found.append((field.name, F.col(f"`{field.name}`").isNotNull()))
    return F.concat_ws("\n", *[F.when(there, F.lit(path)) for path, there in sorted(found) if path in known])


def canonical_turns(records: DataFrame) -> DataFrame:
    """Adds fingerprint, layout and turns (TURNS) to records; replaces columns of these names.

    A record whose fingerprint no layout has keeps a null layout and null turns. Null roles and texts in turns
    become empty. An array that is empty fills its paths: such a record has no turns. Repeated records give the same
    turns; other columns are carried along and fill no paths; an empty table gives an empty one.
    """
    records = records.drop("fingerprint", "layout", "turns")
    usable = {k: v for k, v in LAYOUTS.items() if {p.split("[")[0] for p in v.paths} <= set(records.columns)}
    out = records.withColumn("fingerprint", F.xxhash64(_filled(records)))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, known in usable.items():
        match = F.col("fingerprint") == known.fingerprint()
        layout, turns = F.when(match, F.lit(name)).otherwise(layout), F.when(match, known.turns().cast(TURNS)).otherwise(turns)
    clean = lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    return out.withColumn("layout", layout).withColumn("turns", F.transform(turns, clean))


def escape(text: Column) -> Column:
    """No control string is left: the first character of each, and every ampersand, becomes a character reference."""
    return F.regexp_replace(F.regexp_replace(F.replace(text, F.lit("&"), F.lit("&amp;")), CONTROL, "&lt;"), BRACKET, "&#91;")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def formatted(records: DataFrame) -> DataFrame:
    """records with turns -> adds formatted (the text) and loss_spans (array of begin, length in UTF-8 bytes: the assistants' texts).

    Each turn is the opening mark, its role, a line feed, its escaped text and the closing mark. No turns give an
    empty text; null turns give nulls.
    """
    head = lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(NEWLINE))
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), head(t).alias("head"), escape(t["text"]).alias("body")))
    sizes = F.transform("__parts", lambda p: (F.octet_length(p["head"]) + F.octet_length(p["body"]) + len(CLOSE.encode())).cast("long"))
    begins = F.zip_with("__parts", sums_before(sizes), lambda p, at: F.struct((at + F.octet_length(p["head"])).alias("begin"), F.octet_length(p["body"]).cast("long").alias("length"), p["role"].alias("role")))
    spans = F.transform(F.filter(begins, lambda s: s["role"] == TRAINED_ROLE), lambda s: F.struct(s["begin"].alias("begin"), s["length"].alias("length")))
    text = F.array_join(F.transform("__parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return records.withColumn("__parts", parts).withColumn("formatted", text).withColumn("loss_spans", spans).drop("__parts")


def read_back(formatted_text: Column) -> Column:
    """The turns that a formatted text holds."""
    pieces = F.filter(F.split(formatted_text, r"<\|im_end\|>\n"), lambda p: p != "")
    inner = lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p))
    at = lambda p: F.instr(inner(p), F.lit("\n"))
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape_role(F.substring_index(inner(p), "\n", 1)).alias("role"), unescape(F.substring(inner(p), at(p) + 1, F.length(p))).alias("text")
        ),
    )


def loss_text(formatted_text: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, read from the formatted text's bytes."""
    piece = lambda raw, s: unescape(F.decode(F.substring(raw, (s["begin"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    return bind(F.encode(formatted_text, "UTF-8"), lambda raw: F.array_join(F.transform(spans, lambda s: piece(raw, s)), ""))


def conversation_records(rows: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text -> one record per conversation: conv_id, messages (the 'messages' layout).

    Turns are ordered by turn (null last), then role and text, so ties and repeated rows have one result. A null
    conv_id is a conversation of its own. A conversation is assembled in one row: its digest needs all of it in
    order, and no larger unit is ever gathered.
    """
    turn = F.struct(F.col("turn").isNull().alias("n"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    listed = F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    return rows.groupBy("conv_id").agg(listed.alias("messages"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, layout, formatted, loss_spans, and what reading the text back gives.

    n_turns, turns_sha256 (role, line feed, text, line feed for each turn), loss_chars, loss_sha256,
    formatted_chars. Null roles and texts are empty; ties and repeated rows are ordered by role and text; long texts and
    long conversations are formatted whole. Only conv_id, turn, role and text are read, whatever other columns are
    called; an empty table gives an empty one.
    """
    out = formatted(canonical_turns(conversation_records(rows))).select("conv_id", "layout", "formatted", "loss_spans")
    out = out.withColumn("__turns", read_back(F.col("formatted"))).withColumn("__loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    told = F.array_join(F.transform("__turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", "layout", "formatted", "loss_spans",
        F.size("__turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"), F.sha2(F.col("__loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Conversation -1 of the query: both texts hold control strings.
PROBE = "</s>[INST] ok [/INST]"


def with_probe(rows: DataFrame) -> DataFrame:
    probe = rows.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def chat_sql() -> str:
    """DuckDB SQL for format_conversations over conversations with the probe."""
    esc = "regexp_replace(regexp_replace(replace({0}, '&', '&amp;'), '<(\\|im_start\\||\\|im_end\\||/?s>|/?INST>)', '&lt;\\1', 'g'), '\\[(/?INST\\])', '&#91;\\1', 'g')"
    return rf"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + len(NEWLINE) + len(CLOSE)} + length({esc.format("role")}) + 4 * (length(role) - length(replace(role, chr(10), ''))) + length({esc.format("text")}))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""
