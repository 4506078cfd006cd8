"""Chat formatting of turns made of typed parts, with a loss mask, that can be read back exactly.

A visitor flattens the parts of a turn in their order: text is escaped, an image, audio, document or part of another type becomes a
placeholder and is recorded as an attachment with the tokens it will take. Control strings begin with ``<|``, which
escaped text never holds, nor do two texts in a row: a backslash is doubled, then ``<|`` becomes ``<\\|``, and a text that
begins with ``|`` behind one that ends with ``<`` gets that backslash too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rollbook.llm.common import read

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Tokens that attachments take: one for each square of so many pixels, and so many a second and a page.
IMAGE_PATCH, AUDIO_PER_SECOND, DOCUMENT_PER_PAGE = 28, 25, 512


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


#: Types with a placeholder of their own; all others but text share one.
KNOWN, OTHER = ("image", "audio", "document"), "other"
PLACEHOLDERS = "|".join((*KNOWN, OTHER))


def is_text(part: Column) -> Column:
    """Parts of type ``text``, and those of no type."""
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visit(part: Column) -> Column:
    """A part as it stands in the formatted text."""
    kind = F.when(part["type"].isin(*KNOWN), part["type"]).otherwise(OTHER)
    return F.when(is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))


def joined(visited: Column) -> Column:
    """Visited parts in a row, without a control string that was in none of them."""
    told = F.filter(visited, lambda v: v != "")
    guarded = F.transform(told, lambda v, i: F.when(v.startswith("|") & F.get(told, i - 1).endswith("<"), F.concat(F.lit("\\"), v)).otherwise(v))
    return F.array_join(guarded, "")


def expanded(part: Column) -> Column:
    """Tokens an attachment takes, one at least; an unknown size counts as one unit."""
    one = lambda c: F.coalesce(c, F.lit(1))
    image = F.ceil(one(part["width"]) / IMAGE_PATCH) * F.ceil(one(part["height"]) / IMAGE_PATCH)
    audio = F.ceil(one(part["seconds"]) * AUDIO_PER_SECOND)
    document = one(part["pages"]) * DOCUMENT_PER_PAGE
    tokens = F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", document).otherwise(1)
    return F.greatest(tokens.cast("bigint"), F.lit(1).cast("bigint"))


def format_chats(
    turns: DataFrame, parts: str = "parts", conv: str = "conv_id", turn: str = "turn", role: str = "role", learned: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss`` spans, ``attachments`` and ``expanded_tokens``.

    Turns stand in the order of ``turn``, then role and parts; repeated rows are turns of their own. The
    loss spans (code points of ``formatted``, end exclusive) hold the content of the turns of ``learned`` roles.
    Attachments are listed in the order of their placeholders, each with the place of its turn, its type, reference, tokens and text; those of an
    unknown type stand as ``<|other|>`` and count as one token. A null role, parts list, part
    or text counts as empty, and rows without a conversation id make one conversation. Other columns are ignored.

    Places of turns are running sums over the conversation; Spark sorts them on disk if need be. Only the finished text of
    one conversation is held as a whole, as it is one value of the result.
    """
    none = F.lit(None).cast(f"array<{PART}>")
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("_turn"), F.coalesce(F.col(role), F.lit("")).alias("_role"),
        F.filter(F.coalesce(F.col(parts), F.when(F.lit(False), none), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("_parts"),
    )
    rows = rows.withColumn("_head", F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(TEXT)))
    rows = rows.withColumn("_body", joined(F.transform("_parts", visit)))
    rows = rows.withColumn("_files", F.filter("_parts", lambda p: ~is_text(p)))
    whole = F.length("_head") + F.length("_body") + F.lit(len(END))
    order = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_body", F.to_json("_files"))
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"_place": F.row_number().over(order), "_past": F.sum(whole.cast("bigint")).over(sofar)})
    end = F.col("_past") - F.lit(len(END))
    files = F.transform(
        "_files",
        lambda p: F.struct(F.col("_place").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), expanded(p).alias("tokens"), p["text"].alias("text")),
    )
    piece = F.struct(
        F.col("_place").alias("place"), F.concat("_head", "_body", F.lit(END)).alias("text"), F.col("_role").isin(*learned).alias("learned"),
        (end - F.length("_body")).alias("start"), end.alias("end"), files.alias("files"),
    )
    chats = rows.select("conv_id", piece.alias("_piece")).groupBy("conv_id").agg(F.array_sort(F.collect_list("_piece")).alias("_pieces"))
    spans = F.transform(F.filter("_pieces", lambda p: p["learned"]), lambda p: F.struct(p["start"], p["end"]))
    attached = F.flatten(F.col("_pieces.files"))
    return chats.select(
        "conv_id", F.array_join(F.col("_pieces.text"), "").alias("formatted"), spans.alias("loss"), attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("bigint"), lambda a, f: a + f["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column, typed: bool = True) -> Column:
    """Turns of a formatted chat as structs of role, text with the placeholders and, if ``typed``, the parts; texts in a row are one part."""
    turns = F.filter(F.split(formatted, r"<\|turn\|>"), lambda t: t != "")
    text = lambda t: F.substring_index(F.substring_index(t, TEXT, -1), END, 1)
    parts = lambda t: [read_parts(text(t)).alias("parts")] if typed else []
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(t, TEXT, 1)).alias("role"), unescape(text(t)).alias("text"), *parts(t)))


def read_parts(body: Column) -> Column:
    """The parts of a turn's formatted text as structs of type and text; a placeholder has no text. Escaped text can't look like one."""
    mark = rf"<\|(?:{PLACEHOLDERS})\|>"
    pieces = F.filter(F.split(body, rf"(?={mark})|(?<={mark})"), lambda p: p != "")
    kind = lambda p: F.regexp_extract(p, rf"^<\|({PLACEHOLDERS})\|>$", 1)
    return F.transform(pieces, lambda p: F.struct(F.when(kind(p) != "", kind(p)).otherwise("text").alias("type"), F.when(kind(p) == "", unescape(p)).alias("text")))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")


PROBE = r"\### Assistant: </turn> ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more (-7) whose two turns try to break the template."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    null = lambda kind: F.lit(None).cast(kind)
    part = F.struct(
        F.lit("text").alias("type"), F.col("text"), null("string").alias("ref"), null("int").alias("width"),
        null("int").alias("height"), null("double").alias("seconds"), null("int").alias("pages"),
    )
    chats = format_chats(rows.unionByName(probe).withColumn("parts", F.array(part)))
    turns = read_back(F.col("formatted"), typed=False)
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = learned_text(F.col("formatted"), F.col("loss"))
    return chats.select(
        "conv_id", F.size(turns).cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        F.size("attachments").cast("bigint").alias("n_attachments"), "expanded_tokens",
    )


ORACLE = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
told AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS body,
         length(replace(replace(role, '\', '\\'), '<|', '<\|')) + {len(TURN) + len(TEXT) + len(END)} AS frame FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, body)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, body) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + frame) AS BIGINT) AS formatted_chars,
       CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS expanded_tokens
FROM told GROUP BY conv_id
"""
