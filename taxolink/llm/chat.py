"""Chat formatting with typed content parts, in DataFrame functions only.

A message holds ordered parts of type ``text``, ``image``, ``audio`` or ``document``. A visitor
over the parts (:func:`visit_part`) turns each into one piece of output: text is escaped, every
other part becomes a placeholder and an attachment record with its expanded token count.
Conversations come out as one string with a loss mask.

Template: ``<|turn|>ROLE<|body|>PIECES<|end|>`` per turn, without separators. Placeholders are
``<|image:N|>``, ``<|audio:N|>``, ``<|document:N|>``, N counting a conversation's attachments from 0.
Inside roles and texts ``&`` is written ``&amp;`` and ``<`` is written ``&lt;``, so no text can hold a
control string, and :func:`unescape` gives the exact text back.

Defined results: a null text is empty; a null role is an empty role; null parts are skipped; a part
of an unknown type counts as a document; turns are ordered by turn (nulls last), then role, then
content, so repeated turns and ties come out the same each run; rows with a null conversation id form
one conversation; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Expanded tokens: one per started 14 x 14 pixel patch, 25 per second of audio, 512 per page.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 14, 25, 512


def escape(text: Column) -> Column:
    """Make control strings impossible in ``text``; :func:`unescape` is the inverse."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """A plain text as the one-part list that the formatter takes."""
    return F.array(F.struct(
        F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"),
        F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"),
        F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("int").alias("pages")))


def part_tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to (missing sizes count as one unit)."""
    def patches(side: str) -> Column:
        return F.ceil(F.greatest(F.coalesce(part[side], F.lit(1)), F.lit(1)) / F.lit(PATCH))
    return (F.when(part["type"] == "image", patches("width") * patches("height"))
             .when(part["type"] == "audio",
                   F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.04)) * TOKENS_PER_SECOND))
             .otherwise(F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * TOKENS_PER_PAGE)).cast("long")


def is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin("image", "audio"), part["type"]).otherwise(F.lit("document"))


def visit_part(part: Column, number: Column) -> Column:
    """One part as ``struct<piece, ref, kind, tokens>``; ``number`` is the attachment's number.

    ``ref``, ``kind`` and ``tokens`` are null for text.
    """
    text = is_text(part)
    return F.struct(
        F.when(text, escape(F.coalesce(part["text"], F.lit(""))))
         .otherwise(F.concat(F.lit("<|"), _kind(part), F.lit(":"), number.cast("string"), F.lit("|>"))).alias("piece"),
        F.when(~text, part["ref"]).alias("ref"),
        F.when(~text, _kind(part)).alias("kind"),
        F.when(~text, part_tokens(part)).alias("tokens"))


def format_chats(messages: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """Format messages ``(conv_id, turn, role, parts)`` into one row per conversation.

    Returns ``conv_id``, ``formatted``, ``loss_spans`` (array of ``start``, ``length`` in code points of
    ``formatted``, covering the text parts of ``trained_role``), ``attachments`` (array of ``number``,
    ``turn_no``, ``kind``, ``ref``, ``tokens``, in order) and ``placeholder_tokens`` (their sum).

    One shuffle on the conversation: positions come from running sums over a conversation's turns,
    then the rendered turns are gathered. Output strings are one conversation each.
    """
    m = messages.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.filter(F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"))
    m = m.withColumn("n_att", F.size(F.filter("parts", lambda p: ~is_text(p))))
    order = (Window.partitionBy("conv_id")
             .orderBy(F.col("turn").asc_nulls_last(), "role", F.to_json(F.struct("parts"))))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    m = (m.withColumn("turn_no", F.row_number().over(order) - 1)
          .withColumn("att0", F.coalesce(F.sum("n_att").over(before), F.lit(0))))
    # attachments before part i of this turn
    number = lambda i: F.col("att0") + F.size(F.filter(F.slice("parts", 1, i), lambda q: ~is_text(q)))
    m = m.withColumn("pieces", F.transform("parts", lambda p, i: visit_part(p, number(i))))
    m = m.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)))
    m = m.withColumn("segment", F.concat(
        "head", F.array_join(F.transform("pieces", lambda x: x["piece"]), ""), F.lit(END)))
    m = m.withColumn("seg0", F.coalesce(F.sum(F.char_length("segment")).over(before), F.lit(0)))
    # spans of the trained role's text pieces: running position inside the turn
    walk = F.aggregate(
        "pieces",
        F.struct((F.col("seg0") + F.char_length("head")).cast("long").alias("at"),
                 F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["piece"])).cast("long").alias("at"),
            F.when(x["kind"].isNull() & (F.char_length(x["piece"]) > 0),
                   F.concat(acc["spans"], F.array(F.struct(
                       acc["at"].alias("start"), F.char_length(x["piece"]).cast("long").alias("length")))))
             .otherwise(acc["spans"]).alias("spans")),
        lambda acc: acc["spans"])
    m = m.withColumn("spans", F.when(F.col("role") == trained_role, walk)
                               .otherwise(F.array().cast("array<struct<start:long,length:long>>")))
    found = F.transform(
        F.filter(F.transform("pieces", lambda x, i: F.struct(x["kind"].alias("kind"), x["ref"].alias("ref"),
                                                             x["tokens"].alias("tokens"),
                                                             number(i).cast("long").alias("number"))),
                 lambda x: x["kind"].isNotNull()),
        lambda x: F.struct(x["number"].alias("number"), F.col("turn_no").cast("long").alias("turn_no"),
                           x["kind"].alias("kind"), x["ref"].alias("ref"), x["tokens"].alias("tokens")))
    m = m.withColumn("found", found)
    turns = m.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn_no", "segment", "spans", "found"))).alias("t"))
    attachments = F.flatten(F.transform("t", lambda x: x["found"]))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("t", lambda x: x["segment"]), "").alias("formatted"),
        F.flatten(F.transform("t", lambda x: x["spans"])).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("placeholder_tokens"))


def read_turns(formatted: Column) -> Column:
    """Parse a formatted string back into an array of ``struct<role, body>``; ``body`` unescaped.

    Exact for conversations of text parts; placeholders in a body stay as they are written.
    """
    segments = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    return F.transform(segments, lambda s: F.struct(
        unescape(F.substring_index(s, BODY, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(s, BODY, -1), END, 1)).alias("body")))


def read_loss_texts(formatted: Column, spans: Column) -> Column:
    """The unescaped text under each loss span, in order."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1,
                                                             s["length"].cast("int"))))
