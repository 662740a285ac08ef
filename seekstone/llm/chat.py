"""Chat formatting with typed content parts, as DataFrame functions only.

A message holds *parts* of type text, image, audio or document. A visitor over the parts turns each
into text of the formatted conversation: a text part is escaped, any other part becomes a
placeholder, in order, and leaves a reference to its attachment with the number of tokens that it
expands to. Text parts that follow one another are one run and escaped as one, so that no control
string can be put together from the ends of two parts. Control strings that stand in a text are escaped reversibly, so that the formatted
string can be read back without loss.

A turn is ``<|turn|>ROLE\\nCONTENT<|end|>\\n``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, END = "<|turn|>", "<|end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}

PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: What is escaped: the backslash itself, and the first character of each control string.
ESCAPES = ((r"\\", r"\\5c"), (r"<(\|)", r"\\3c$1"), (r"<(/?s>)", r"\\3c$1"), (r"<(</?SYS>>)", r"\\3c$1"), (r"\[(/?INST\])", r"\\5b$1"))
UNESCAPES = (("\\3c", "<"), ("\\5b", "["), ("\\0a", "\n"), ("\\5c", "\\"))


@dataclass(frozen=True)
class ExpansionCosts:
    """Tokens that an attachment expands to: an image by patches, audio by seconds, documents by pages."""

    patch: int = 14
    audio_tokens_per_second: float = 25.0
    tokens_per_page: int = 512


def escape(text: Column) -> Column:
    """``text`` (null: empty) with backslashes and control strings escaped."""
    out = F.coalesce(text, F.lit(""))
    for pattern, to in ESCAPES:
        out = F.regexp_replace(out, pattern, to)
    return out


def escape_role(role: Column) -> Column:
    """A role stands on the first line of its turn: line feeds are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\0a"))


def unescape(text: Column) -> Column:
    """The inverse of ``escape`` and ``escape_role``."""
    for what, to in UNESCAPES:
        text = F.replace(text, F.lit(what), F.lit(to))
    return text


def visit_text(part: Column, costs: ExpansionCosts) -> tuple[Column, Column]:
    return escape(part["text"]), F.lit(0).cast("long")


def visit_image(part: Column, costs: ExpansionCosts) -> tuple[Column, Column]:
    side = lambda x: F.ceil(F.greatest(F.coalesce(x, F.lit(0)), F.lit(0)) / costs.patch)
    return F.lit(PLACEHOLDERS["image"]), (side(part["width"]) * side(part["height"])).cast("long")


def visit_audio(part: Column, costs: ExpansionCosts) -> tuple[Column, Column]:
    return F.lit(PLACEHOLDERS["audio"]), F.ceil(F.greatest(F.nanvl(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) * costs.audio_tokens_per_second).cast("long")


def visit_document(part: Column, costs: ExpansionCosts) -> tuple[Column, Column]:
    return F.lit(PLACEHOLDERS["document"]), (F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(0)) * costs.tokens_per_page).cast("long")


VISITORS = {"image": visit_image, "audio": visit_audio, "document": visit_document}


def runs_of(parts: Column) -> Column:
    """The parts with each run of text parts joined to one; a null array is empty, a null part or one of
    unknown type is text, and a null text is empty."""
    kind = lambda p: F.when(p["type"].isin(*VISITORS), p["type"]).otherwise(F.lit("text"))
    plain = F.transform(F.coalesce(parts, F.array().cast(f"array<{PART_TYPE}>")), lambda p: F.struct(kind(p).alias("type"), F.coalesce(p["text"], F.lit("")).alias("text"), *(p[c].alias(c) for c in ("ref", "width", "height", "seconds", "pages"))).cast(PART_TYPE))
    # a run starts where a part or the one before it is no text; its number tells its parts
    starts = F.transform(plain, lambda p, i: (i == 0) | (p["type"] != "text") | (F.get(plain, i - 1)["type"] != "text"))
    first = F.filter(F.transform(starts, lambda s, i: F.when(s, i)), lambda i: i.isNotNull())
    upto = lambda k: F.coalesce(F.get(first, k + 1), F.size(plain))

    def run(at: Column, k: Column) -> Column:
        held = F.slice(plain, at + 1, upto(k) - at)
        return F.struct(held[0]["type"].alias("type"), F.array_join(F.transform(held, lambda p: p["text"]), "").alias("text"), *(held[0][c].alias(c) for c in ("ref", "width", "height", "seconds", "pages"))).cast(PART_TYPE)

    return F.when(F.size(plain) <= 1, plain).otherwise(F.transform(first, run))


def flatten_parts(parts: Column, costs: ExpansionCosts = ExpansionCosts()) -> Column:
    """``array<struct<text,kind,ref,tokens>>``: what each run of text parts and each other part becomes,
    in order. Sizes that are null, negative or no number count as 0."""

    def one(part: Column) -> Column:
        text, tokens = visit_text(part, costs)
        for kind, visit in VISITORS.items():
            shown, n = visit(part, costs)
            text, tokens = F.when(part["type"] == kind, shown).otherwise(text), F.when(part["type"] == kind, n).otherwise(tokens)
        return F.struct(text.alias("text"), part["type"].alias("kind"), part["ref"].alias("ref"), tokens.alias("tokens"))

    return F.transform(runs_of(parts), one)


def text_part(text: Column) -> Column:
    """A single text part as an array of parts."""
    return F.array(F.named_struct(F.lit("type"), F.lit("text"), F.lit("text"), text, F.lit("ref"), F.lit(None), F.lit("width"), F.lit(None), F.lit("height"), F.lit(None), F.lit("seconds"), F.lit(None), F.lit("pages"), F.lit(None))).cast(f"array<{PART_TYPE}>")


def format_conversations(messages: DataFrame, costs: ExpansionCosts = ExpansionCosts()) -> DataFrame:
    """Format ``messages(conv_id, turn, role, parts)``, one row per conversation.

    Returns ``conv_id``, ``n_turns``, ``formatted``, ``loss_spans`` (start and length, in code
    points of ``formatted``, of each assistant content), ``attachments`` (kind, ref, turn number
    from 0, start of its placeholder's content, expanded tokens, in order) and ``expanded_tokens``.

    Turns go by ``turn`` (null first), ties by role and content; repeated rows are repeated turns.
    A null role or text is empty, null ``conv_id`` is a conversation of its own, other columns are
    ignored, and no rows give no rows. One conversation is one row, so a conversation must fit a
    row; conversations are never joined with each other.
    """
    shown = messages.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        flatten_parts(F.col("parts"), costs).alias("flat"),
    ).select(
        "conv_id",
        "turn",
        "role",
        "flat",
        F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n")).alias("head"),
        F.array_join(F.col("flat")["text"], "").alias("content"),
    )
    shown = shown.withColumn("size", F.length("head") + F.length("content") + F.lit(len(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "content")
    shown = shown.withColumn("start", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    turn = F.struct("start", F.concat("head", "content", F.lit(END)).alias("shown"), (F.col("start") + F.length("head")).alias("at"), F.length("content").alias("n"), (F.col("role") == "assistant").alias("loss"), "flat")
    whole = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    attached = F.flatten(
        F.transform(
            "turns",
            lambda t, i: F.transform(F.filter(t["flat"], lambda p: p["kind"] != "text"), lambda p: F.struct(p["kind"].alias("kind"), p["ref"].alias("ref"), i.alias("turn"), t["at"].alias("content_start"), p["tokens"].alias("tokens"))),
        )
    )
    whole = whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.col("turns")["shown"], "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["at"].alias("start"), t["n"].alias("length"))).alias("loss_spans"),
        attached.alias("attachments"),
    )
    return whole.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def parse_formatted(formatted: Column) -> Column:
    """``array<struct<role,text>>`` read back from a formatted conversation, with texts unescaped.

    Placeholders of attachments stay in the text as they are.
    """
    pieces = F.filter(F.split(formatted, "<\\|end\\|>\n"), lambda x: x != "")
    body = F.transform(pieces, lambda x: F.substr(x, F.lit(len(TURN) + 1)))
    return F.transform(
        body,
        lambda x: F.struct(unescape(F.substring_index(x, "\n", 1)).alias("role"), unescape(F.substr(x, F.length(F.substring_index(x, "\n", 1)) + F.lit(2))).alias("text")),
    )


def masked_texts(formatted: Column, loss_spans: Column) -> Column:
    """The texts under the loss mask, cut from the formatted conversation and unescaped, in order."""
    return F.transform(loss_spans, lambda x: unescape(F.substr(formatted, (x["start"] + 1).cast("int"), x["length"].cast("int"))))


def digests(formatted: DataFrame) -> DataFrame:
    """Columns of the query: digests of the turns and of all text under the loss mask, read back."""
    read = formatted.withColumn("read", parse_formatted(F.col("formatted")))
    loss = F.array_join(masked_texts(F.col("formatted"), F.col("loss_spans")), "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
