"""Chat formatting of typed content parts, with DataFrame functions only.

A message's content is an array of parts {kind, text, ref, units}. A visitor expression flattens the parts in order:
runs of neighbouring text parts are joined and then escaped, so that no control string can arise where two parts meet;
an image, audio or document part becomes a placeholder, its reference goes to the attachments and its units (image
tiles, seconds of audio, document pages) are expanded to token counts.

Template: ``<|turn|>role<|text|>content<|end|>`` for each turn. Every control string in a role, text or reference is
escaped by one more backslash behind its first character (``</s>`` becomes ``<\\/s>``, and that ``<\\\\/s>``), so the
change is undone by taking one away, and no text can open, close or mask a turn. Control strings are those of this
template and the common ones of others.

The loss mask is a list of spans of ``formatted``, the content of each assistant turn: {start, chars} in code points and
{at, bytes} in UTF-8, by which a span is cut out without walking the text.

Turns are formatted row by row, gathered in blocks of ``BLOCK`` turns and then by conversation.

Edge cases: null texts, roles and parts are empty; texts of any length are taken whole; rows that repeat a turn follow
by role, then content; a row with a null conv_id belongs to no conversation and is formatted as one of its own; an
empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BLOCK = 256  #: turns gathered before blocks are joined
LEARNT = "assistant"  #: role whose content the loss mask covers

# The template's marks, and what counts as a control string behind its first character.
TURN, TEXT, END, PART = "<|turn|>", "<|text|>", "<|end|>", "<|part|>"
_REST = r"(\|[A-Za-z0-9_:]+\|>|/?s>|/?INST\]|/?SYS>>|/?[A-Z]+\])"
_ESCAPE = r"([<\[])(\\*)" + _REST
_UNESCAPE = r"([<\[])\\(\\*)" + _REST
#: Tokens that one unit of a part takes: a tile of an image, a second of sound, a page of a document.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 512}
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), _ESCAPE, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, _UNESCAPE, "$1$2$3")


def _is_text(p: Column) -> Column:
    return F.coalesce(p["kind"], F.lit("text")) == "text"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value computed once even where lambdas in f use it for every element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def visit(parts: Column) -> Column:
    """Parts flattened in order: {content, attachments: [{kind, ref, tokens, place}], media_tokens}."""
    parts = F.coalesce(parts, F.from_json(F.lit("[]"), PARTS))
    tokens = lambda p: F.coalesce(p["units"], F.lit(1)) * F.coalesce(F.element_at(F.create_map(*[x for k, v in UNIT_TOKENS.items() for x in (F.lit(k), F.lit(v))]), p["kind"]), F.lit(1))
    placed = F.transform(parts, lambda p, i: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), tokens(p).alias("tokens"), i.alias("place")))
    media = F.filter(placed, lambda x: F.coalesce(x["kind"], F.lit("text")) != "text")
    mark = lambda x: F.concat(F.lit(PART), escape(F.concat_ws(":", F.coalesce(x["kind"], F.lit("")), F.coalesce(x["ref"], F.lit("")))), F.lit(PART))

    def flat(both: Column) -> Column:
        """Run, placeholder, run, placeholder, ..., run: run i lies between media parts i - 1 and i."""
        own, m = both["parts"], both["media"]
        start = lambda i: F.when(i == 0, 0).otherwise(F.get(m, i - 1)["place"] + 1)
        stop = lambda i: F.coalesce(F.get(m, i)["place"], F.size(own))
        run = lambda i: escape(F.array_join(F.transform(F.slice(own, start(i) + 1, stop(i) - start(i)), lambda p: F.coalesce(p["text"], F.lit(""))), ""))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(m)), lambda i: F.concat(run(i), F.when(i < F.size(m), mark(F.get(m, i))).otherwise(""))), "")

    return _bound(
        F.struct(parts.alias("parts"), media.alias("media")),
        lambda both: F.struct(flat(both).alias("content"), both["media"].alias("attachments"), F.aggregate(both["media"], F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("media_tokens")),
    )


def text_part(c: Column) -> Column:
    """Plain text as parts."""
    return F.array(F.struct(F.lit("text").alias("kind"), c.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def format_chats(turns: DataFrame, parts_col: str = "parts") -> DataFrame:
    """(conv_id, turn, role, parts) to (conv_id, formatted, loss, attachments, media_tokens)."""
    seen = turns.select("conv_id", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone"), "turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.col(parts_col)).alias("v"))
    lead = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    rows = seen.select(
        "conv_id", "alone", "turn", "role", F.col("v.content").alias("content"), F.col("v.attachments").alias("attachments"), F.col("v.media_tokens").alias("media_tokens"), lead.alias("lead"),
    ).select(
        "conv_id", "alone", "turn", "role", "attachments", "media_tokens", F.concat("lead", "content", F.lit(END)).alias("turn_text"),
        F.struct(
            *(f(c).cast("long").alias(n) for f, names in ((F.char_length, ("lead", "chars", "all")), (F.octet_length, ("lead_bytes", "bytes", "all_bytes"))) for n, c in zip(names, (F.col("lead"), F.col("content"), F.concat("lead", "content", F.lit(END))), strict=True))
        ).alias("len"),
    )
    key = F.struct("turn", "role", "turn_text", "attachments", "len")
    blocks = rows.groupBy("conv_id", "alone", F.floor(F.col("turn") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(key)).alias("t"), F.sum("media_tokens").alias("media_tokens"))

    def spans(t: Column) -> Column:
        """Assistant contents by their place in the block: a fold over its at most few hundred turns."""
        empty = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).cast("long").alias("b"), F.expr("CAST(array() AS array<struct<start:bigint,chars:bigint,at:bigint,bytes:bigint>>)").alias("s"))
        span = lambda a, x: F.struct((a["c"] + x["len"]["lead"]).alias("start"), x["len"]["chars"].alias("chars"), (a["b"] + x["len"]["lead_bytes"]).alias("at"), x["len"]["bytes"].alias("bytes"))
        step = lambda a, x: F.struct((a["c"] + x["len"]["all"]).alias("c"), (a["b"] + x["len"]["all_bytes"]).alias("b"), F.when(x["role"] == LEARNT, F.concat(a["s"], F.array(span(a, x)))).otherwise(a["s"]).alias("s"))
        return F.aggregate(t, empty, step)

    blocks = blocks.select(
        "conv_id", "alone", "block", "media_tokens", F.array_join(F.col("t.turn_text"), "").alias("text"), F.flatten(F.col("t.attachments")).alias("attachments"), spans(F.col("t")).alias("sum")
    )
    before = Window.partitionBy("conv_id", "alone").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    past = lambda c: F.coalesce(F.sum(f"sum.{c}").over(before), F.lit(0)).cast("long")
    blocks = blocks.withColumn("pc", past("c")).withColumn("pb", past("b"))
    shift = F.transform("sum.s", lambda x: F.struct((x["start"] + F.col("pc")).alias("start"), x["chars"].alias("chars"), (x["at"] + F.col("pb")).alias("at"), x["bytes"].alias("bytes")))
    whole = blocks.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list(F.struct("block", "text", shift.alias("loss"), "attachments"))).alias("b"), F.sum("media_tokens").alias("media_tokens"))
    return whole.select("conv_id", F.array_join(F.col("b.text"), "").alias("formatted"), F.flatten(F.col("b.loss")).alias("loss"), F.flatten(F.col("b.attachments")).alias("attachments"), "media_tokens")


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Reads the turns back from the formatted text: (conv_id, formatted, loss, turns: [{role, text}]), escapes undone."""
    pieces = F.filter(F.split(F.col("formatted"), r"<\|end\|>"), lambda x: x != "")
    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), TEXT, 1)).alias("role"),
        unescape(F.element_at(F.split(x, r"<\|text\|>", 2), 2)).alias("text"),
    )
    return formatted.select("conv_id", "formatted", "loss", F.transform(pieces, turn).alias("turns"))


def masked(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, as they stand in ``formatted``."""
    return _bound(F.encode(formatted, "UTF-8"), lambda b: F.transform(loss, lambda s: F.decode(F.substring(b, s["at"].cast("int") + 1, s["bytes"].cast("int")), "UTF-8")))


def digests(parsed: DataFrame) -> DataFrame:
    said = F.array_join(F.transform(masked(F.col("formatted"), F.col("loss")), unescape), "")
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), said.alias("said")).select(
        "conv_id", "n_turns", F.sha2(F.encode("whole", "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("said").cast("long").alias("loss_chars"), F.sha2(F.encode("said", "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = rows.unionByName(extra).withColumn("parts", text_part(F.col("text")))
    return digests(parse_chats(format_chats(turns)))


OP9_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]', NULL UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]', NULL),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\|[A-Za-z0-9_:]+\|>|/?s>|/?INST\]|/?SYS>>|/?[A-Z]+\])', '\1\\\2\3', 'g') AS erole,
    regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_:]+\|>|/?s>|/?INST\]|/?SYS>>|/?[A-Z]+\])', '\1\\\2\3', 'g') AS etext FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, etext)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, etext) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(23 + length(erole) + length(etext)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, alone
"""
