"""Chat formatting of typed content parts, in DataFrame expressions only.

A visitor has one rule for each part type: text is escaped; image, audio and document parts become placeholders in
their order, with their reference and the tokens that they expand to recorded beside. A turn is

    <|im_start|>role NEWLINE content<|im_end|>NEWLINE

Every control string starts with "<". Inside texts and roles a backslash is written as backslash b and "<" as backslash l
(and in roles a newline as backslash n). That is done character by character, so parts can be escaped one by one and
joined: no input can imitate a control string, not even in pieces, and everything reads back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<type:string,text:string,ref:string,units:double>>"
#: Tokens a unit: an image, a second of audio, a page of a document.
TOKENS = {"image": 576.0, "audio": 25.0, "document": 1024.0}


def swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return swap(swap(text, "\\", "\\b"), "<", "\\l")


def unescape(text: Column) -> Column:
    return swap(swap(text, "\\l", "<"), "\\b", "\\")


def escape_role(role: Column) -> Column:
    return swap(escape(role), "\n", "\\n")


def unescape_role(role: Column) -> Column:
    return unescape(swap(role, "\\n", "\n"))


def visitor(tokens: dict[str, float] | None = None) -> dict[str, Callable[[Column], Column]]:
    """Rules by part type, each giving (plain, content, ref, tokens) of a part: what it says, and how that is written."""
    none = F.lit(None).cast("string")

    def text(p: Column) -> Column:
        plain = F.coalesce(p["text"], F.lit(""))
        return F.struct(plain.alias("plain"), escape(plain).alias("content"), none.alias("ref"), F.lit(0).cast("long").alias("tokens"))

    def attached(kind: str, rate: float) -> Callable[[Column], Column]:
        return lambda p: F.struct(F.lit(f"<|{kind}|>").alias("plain"), F.lit(f"<|{kind}|>").alias("content"), F.coalesce(p["ref"], F.lit("")).alias("ref"), F.ceil(F.coalesce(p["units"], F.lit(1.0)) * rate).cast("long").alias("tokens"))

    return {"text": text} | {k: attached(k, r) for k, r in (tokens or TOKENS).items()}


def flatten(parts: Column, rules: dict[str, Callable[[Column], Column]]) -> Column:
    """Struct of a message's plain text and content, and its attachments in order with their tokens. A part of unknown or null type is text."""

    def visit(p: Column) -> Column:
        out = rules["text"](p)
        for kind, rule in rules.items():
            if kind != "text":
                out = F.when(p["type"] == kind, rule(p)).otherwise(out)
        return out

    def joined(v: Column) -> Column:
        refs = F.transform(F.filter(v, lambda x: x["ref"].isNotNull()), lambda x: F.struct(x["ref"].alias("ref"), x["tokens"].alias("tokens")))
        plain, content = F.transform(v, lambda x: x["plain"]), F.transform(v, lambda x: x["content"])
        return F.struct(F.array_join(plain, "").alias("plain"), F.array_join(content, "").alias("content"), refs.alias("attachments"))

    visited = F.transform(F.coalesce(parts, F.array().cast(PARTS)), visit)
    return F.transform(F.array(visited), joined)[0]


def text_parts(text: Column) -> Column:
    one = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("units"))
    return F.array(one)


def format_chats(turns: DataFrame, learn: str = "assistant", tokens: dict[str, float] | None = None) -> DataFrame:
    """One row per conversation of turns (conv_id, turn, role, parts, any other columns).

    Returns conv_id, formatted (the text), spans (of each turn in order: start, mask_start and mask_end in code
    points, the latter two null for roles other than `learn`), attachments (ref, tokens) in order. Turns go by turn
    (null first), equal ones by role, plain text and content. Null roles are empty, null parts none; rows without conv_id are
    one conversation. An empty table gives an empty result.
    """
    flat = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), flatten(F.col("parts"), visitor(tokens)).alias("m"))
    head = F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))
    rows = flat.select("conv_id", "turn", "role", head.alias("head"), F.col("m.plain").alias("plain"), F.col("m.content").alias("content"), F.col("m.attachments").alias("files"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "plain", "content")
    size = F.char_length("head") + F.char_length("content") + len(CLOSE)
    placed = rows.withColumns({"pos": F.row_number().over(order), "start": (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) - size).cast("long")})
    learned = F.col("role") == learn
    inner = F.col("start") + F.char_length("head")
    mask = [F.when(learned, inner).alias("mask_start"), F.when(learned, inner + F.char_length("content")).alias("mask_end")]
    turn = F.struct("pos", F.concat("head", "content", F.lit(CLOSE)).alias("said"), F.struct("start", *mask).alias("span"), "files")
    chats = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return chats.select("conv_id", F.array_join("t.said", "").alias("formatted"), F.col("t.span").alias("spans"), F.flatten("t.files").alias("attachments"))


def read_back(chats: DataFrame) -> DataFrame:
    """The turns of formatted conversations, from their text alone, and what is under the loss mask.

    Returns conv_id, turns (role, text), learned (texts under the mask, unescaped) and formatted.
    """
    said = F.split("formatted", r"<\|im_start\|>")
    pieces = F.slice(said, 2, F.greatest(F.size(said) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substring(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 1 - len(CLOSE))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    def masked(p: Column, s: Column) -> Column:
        return F.when(s["mask_start"].isNotNull(), unescape(F.substring(p, (s["mask_start"] - s["start"] - len(OPEN) + 1).cast("int"), (s["mask_end"] - s["mask_start"]).cast("int"))))

    parts = chats.select("conv_id", "formatted", "spans", pieces.alias("p"))
    return parts.select("conv_id", F.transform("p", turn).alias("turns"), F.filter(F.zip_with("p", "spans", masked), lambda x: x.isNotNull()).alias("learned"), "formatted")
