"""Chat formatting of typed content parts, in DataFrame expressions only.

A conversation's messages hold ordered parts (text, image, audio, document).
Each part becomes template text: texts are escaped, other parts become
placeholders while their reference and token count go to a list of
attachments. The template is

    ### <role>\n<content></turn>\n

Inside texts, roles and references, backslash, '<' and '#' (and a line end in
a role) are written as a backslash and a letter, so no control string can
occur there, and the formatted text splits back without guessing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txrisk.llm._common import let

HEAD, TAIL = "### ", "</turn>\n"
#: Character and its escaped form, in the order of escaping.
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("#", "\\h")]
LINE_END = ("\n", "\\n")
PART_TYPE = "array<struct<type:string,text:string,ref:string,tokens:int>>"
#: Tokens that a placeholder stands for when a part gives no count.
PLACEHOLDER_TOKENS = {"image": 256, "audio": 128, "document": 512}


def escape(text: Column, line_ends: bool = False) -> Column:
    for raw, coded in ESCAPES + ([LINE_END] if line_ends else []):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for raw, coded in [LINE_END, *reversed(ESCAPES)]:
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def text_parts(text: Column) -> Column:
    """The parts of a plain text message; null text is empty."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            F.coalesce(text, F.lit("")).alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("tokens"),
        )
    )


def visit_part(part: Column) -> Column:
    """A part as (piece, is_text, type, ref, tokens). Texts are escaped; an
    image, audio or document part is one placeholder ``<type>``; the tokens it
    expands to are recorded, the part's own count or the type's usual one. A part of an unknown or null type counts as text; null text is empty."""
    kind = F.lower(part["type"])
    is_text = ~F.coalesce(kind.isin(*PLACEHOLDER_TOKENS), F.lit(False))
    usual = F.lit(0)
    for name, n in PLACEHOLDER_TOKENS.items():
        usual = F.when(kind == name, F.lit(n)).otherwise(usual)
    return F.struct(
        F.when(is_text, escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind, F.lit(">"))).alias("piece"),
        is_text.alias("is_text"),
        kind.alias("type"),
        part["ref"].alias("ref"),
        F.when(is_text, F.lit(0)).otherwise(F.coalesce(part["tokens"], usual)).alias("tokens"),
    )


def format_messages(
    messages: DataFrame,
    parts_col: str = "parts",
    key: str = "conv_id",
    loss_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per conversation: key, n_turns, formatted, loss_spans, attachments.

    ``messages`` has key, turn, role and a column of parts (PART_TYPE). Turns
    are ordered by turn (null first), ties by role and content; repeated rows
    stay. loss_spans are [start, end) byte ranges of ``formatted`` (UTF-8) that
    hold the content of turns of ``loss_roles``. attachments lists, in order,
    (turn_index, type, ref, tokens) of the placeholders. A null key is a
    conversation of its own, a null role is empty, null or empty parts are an
    empty text; an empty table gives no rows; other columns are ignored.

    Per-turn work runs before the shuffle; a row holds one conversation, which
    the output has to hold whole anyway.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(PART_TYPE))
    turns = messages.select(
        F.col(key), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.transform(parts, visit_part).alias("visited"),
    )
    head = F.concat(F.lit(HEAD), escape(F.col("role"), line_ends=True), F.lit("\n"))
    turns = turns.select(
        key,
        F.struct(
            F.col("turn").alias("turn"),
            F.col("role").alias("role"),
            head.alias("head"),
            F.array_join(F.col("visited")["piece"], "").alias("content"),
            F.filter("visited", lambda p: ~p["is_text"]).alias("attached"),
            F.col("role").isin(*loss_roles).alias("loss"),
        ).alias("t"),
    )
    # byte position of each turn in the formatted text
    size = F.octet_length("t.head") + F.octet_length("t.content") + F.lit(len(TAIL))
    before = Window.partitionBy(key).orderBy("t.turn", "t.role", "t.content").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("at", F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0)))
    ordered = turns.groupBy(key).agg(
        F.count("*").alias("n_turns"),
        F.sort_array(F.collect_list(F.struct(F.col("at"), F.col("t.*")))).alias("ts"),
    )
    begin = lambda t: t["at"] + F.octet_length(t["head"])
    spans = F.transform(
        F.filter("ts", lambda t: t["loss"]),
        lambda t: F.struct(begin(t).alias("start"), (begin(t) + F.octet_length(t["content"])).alias("end")),
    )
    attached = F.flatten(
        F.transform(
            "ts",
            lambda t, i: F.transform(
                t["attached"],
                lambda p: F.struct(i.alias("turn_index"), p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens")),
            ),
        )
    )
    return ordered.select(
        key,
        "n_turns",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["content"], F.lit(TAIL))), "").alias("formatted"),
        spans.alias("loss_spans"),
        attached.alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation;
    placeholders stay in the text as written."""
    turns = F.filter(F.split(formatted, TAIL), lambda t: t != "")
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substr(F.substring_index(t, "\n", 1), F.lit(len(HEAD) + 1))).alias("role"),
            unescape(F.substr(t, F.instr(t, "\n") + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    return let(
        F.encode(formatted, "utf-8"),
        lambda whole: F.array_join(
            F.transform(
                spans,
                lambda s: unescape(
                    F.decode(F.substr(whole, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")), "utf-8")
                ),
            ),
            "",
        ),
    )
