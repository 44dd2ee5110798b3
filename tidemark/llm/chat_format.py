"""Chat formatting with typed content parts.

A message is a role and an ordered array of parts: text, image, audio or
document. The formatter visits the parts in order; text is escaped, every
attachment becomes a placeholder, and its reference and expanded token count
are recorded in the order of the placeholders. The template marks turns with
control strings that no escaped text can contain, so the output can be split
into its turns again and unescaping returns the exact texts. The loss mask is
a list of spans of code points, one per assistant text.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = ("struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>")
BEGIN, TURN, SAYS, END = "<|begin|>", "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Control strings of this and of other common templates, and their escaped forms; the backslash comes first.
ESCAPES = [("\\", "\\\\"), ("<|", "<\\|"), ("</s>", "<\\/s>"), ("<s>", "<\\s>"), ("[INST]", "[\\INST]"),
           ("[/INST]", "[\\/INST]")]
PATCH, AUDIO_TOKENS_A_SECOND, TOKENS_A_PAGE = 14, 25, 256


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """A backslash after a backslash, ``<`` or ``[`` goes; all others were never added."""
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as a message of one part; null as empty."""
    none = [F.lit(None).cast(t) for t in ("string", "int", "int", "double", "int")]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"),
                            *[n.alias(k) for n, k in zip(none, ("ref", "width", "height", "seconds", "pages"))]))


def expanded_tokens(part: Column) -> Column:
    """Tokens an attachment takes in the model: image patches, audio frames, pages; at least 1."""
    return F.greatest(F.lit(1).cast("long"), F.coalesce(
        F.when(part["type"] == "image", F.ceil(part["width"] / PATCH) * F.ceil(part["height"] / PATCH))
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_TOKENS_A_SECOND))
        .when(part["type"] == "document", part["pages"].cast("long") * TOKENS_A_PAGE),
        F.lit(1).cast("long")))


def _flat(parts: Column) -> Column:
    def visit(part):
        shown = F.lit("")
        for kind, mark in PLACEHOLDERS.items():
            shown = F.when(part["type"] == kind, F.lit(mark)).otherwise(shown)
        return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(shown)
    return F.array_join(F.transform(parts, visit), "")


def _attached(parts: Column) -> Column:
    kept = F.filter(parts, lambda p: p["type"].isin(*PLACEHOLDERS))
    return F.transform(kept, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"),
                                                expanded_tokens(p).alias("tokens")))


def format_conversations(messages: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """Messages (conv_id, turn, role, parts) -> one row per conversation.

    Columns: conv_id, n_turns, formatted, loss_spans (start, length in code
    points, each over the text of one turn of ``loss_role``), attachments
    (type, ref, tokens, in placeholder order), attachment_tokens.

    Rows are put in order of turn (null first), then role, then content;
    repeated rows are turns of their own. A null role is empty. Null parts, and
    parts of an unknown or null type, are left out; a text part's null text is
    empty. Rows with a null conv_id form one conversation.
    """
    rows = messages.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.filter(
        F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull()).alias("parts"))
    rows = rows.select("conv_id", "turn", "role", _flat(F.col("parts")).alias("content"),
                       _attached(F.col("parts")).alias("attached"))
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    rows = rows.withColumn("head", F.length(head).cast("long")).withColumn(
        "piece", F.concat(head, F.col("content"), F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", before + len(BEGIN))
    turns = F.sort_array(F.collect_list(F.struct("at", "piece", "role", "head", F.length("content").alias("chars"),
                                                 "attached")))
    told = rows.groupBy("conv_id").agg(turns.alias("turns"))
    learnt = F.transform(F.filter("turns", lambda t: t["role"] == loss_role), lambda t: F.struct(
        (t["at"] + t["head"]).alias("start"), t["chars"].cast("long").alias("length")))
    attachments = F.flatten(F.transform("turns", lambda t: t["attached"]))
    return told.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("formatted"),
        learnt.alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted conversation: array of (role, text); placeholders carry no text."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>"), lambda p: F.contains(p, F.lit(TURN)))
    marks = r"<\|(?:image|audio|document)\|>"
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)<\|turn\|>(.*?)<\|says\|>", 1)).alias("role"),
        unescape(F.regexp_replace(F.regexp_extract(p, r"(?s)<\|says\|>(.*)$", 1), marks, "")).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    marks = r"<\|(?:image|audio|document)\|>"
    return F.transform(spans, lambda s: unescape(F.regexp_replace(F.substring(
        formatted, s["start"].cast("int") + 1, s["length"].cast("int")), marks, "")))
