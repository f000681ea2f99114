r"""Chat formatting with typed content parts, on DataFrame functions alone.

A message is a list of parts of the types text, image, audio and document. A
visitor walks the parts of a whole conversation in order: a text part is
escaped, any other becomes a numbered placeholder ``<|image:3|>``; its
reference and its expanded token count are recorded as an attachment.

Template, per turn: ``<|turn|>`` role ``<|says|>`` content ``<|end|>``.
Escaping: a backslash is doubled, and each ``<`` and ``[`` inside a role or
text is followed by ``\;``. So no control string (``<|end|>``, ``</s>``,
``[INST]``, ...) can be spelled by a text, not even across two parts, and
the original comes back by one left-to-right replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Tokens that one unit of a part stands for: an image tile, a second of audio, a page.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}
PARTS = "array<struct<type:string,text:string,ref:string,units:bigint>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([<\[])", r"$1\\;")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)|\\;", "$1")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("units"))).cast(PARTS)


def _placeholder(part: Column, number: Column) -> Column:
    """Only plain names are shown: a type can spell neither a control string nor the end of its own placeholder."""
    shown = F.when(part["type"].rlike("^[A-Za-z0-9_-]{1,40}$"), part["type"]).otherwise(F.lit("part"))
    return F.concat(F.lit("<|"), shown, F.lit(":"), number.cast("string"), F.lit("|>"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def format_conversations(messages: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, formatted, n_turns, attachments, expanded_tokens.

    - Rows come by turn; ties by role, then parts; repeated rows are turns
      of their own. Null roles and texts are empty; a null list of parts is
      an empty content; a null id is a conversation of its own.
    - attachments: array of (number, type, ref, tokens) in order; number is
      the part's place in the conversation, from 1, as in its placeholder.
    - Unknown part types count 1 token a unit; in the placeholder a type that
      is no plain name (letters, digits, _ and -) is shown as "part".
    - An empty table gives no rows; other columns are ignored.

    A conversation is one output value, so its turns meet in one row; escape
    and placeholder work happens before, on the rows where they lie.
    """
    rows = messages.select(
        F.col(id_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.transform(F.col(parts_col), lambda p: F.when(_is_text(p), F.struct(F.lit("text").alias("type"), escaped(F.coalesce(p["text"], F.lit(""))).alias("text"), p["ref"].alias("ref"), p["units"].alias("units"))).otherwise(p)).cast(PARTS), F.array().cast(PARTS)).alias("parts"),
        ).alias("message"),
    )
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("messages"))

    def visited(message: Column, m: Column) -> Column:
        """Head, parts and end of a message as pieces (text, part); m messages, so 2 m + 1 other pieces, stand before its parts."""
        plain = lambda text: F.struct(text.alias("text"), F.lit(None).cast("string").alias("type"), m.alias("m"))
        part = lambda p: F.struct(F.when(_is_text(p), p["text"]).alias("text"), p["type"].alias("type"), m.alias("m"))
        return F.concat(F.array(plain(F.concat(F.lit(TURN), escaped(message["role"]), F.lit(SAYS)))), F.transform(message["parts"], part), F.array(plain(F.lit(END))))

    pieces = F.flatten(F.transform("messages", visited))
    formatted = F.array_join(F.transform(pieces, lambda p, i: F.coalesce(p["text"], _placeholder(p, i - 2 * p["m"]))), "")
    per_unit = F.lit(1)
    numbered = F.transform(F.flatten(F.transform("messages", lambda m: m["parts"])), lambda p, i: F.struct((i + 1).alias("number"), p["type"].alias("type"), p["ref"].alias("ref"), (F.coalesce(p["units"], F.lit(1)) * _tokens(p["type"], per_unit)).alias("tokens")))
    return talks.select(
        "conv_id",
        formatted.alias("formatted"),
        F.size("messages").cast("long").alias("n_turns"),
        F.filter(numbered, lambda a: F.coalesce(a["type"], F.lit("text")) != "text").alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, a: acc + a["tokens"]))


def _tokens(kind: Column, default: Column) -> Column:
    out = default
    for name, tokens in TOKENS_PER_UNIT.items():
        out = F.when(kind == name, F.lit(tokens)).otherwise(out)
    return out


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> parsed from the formatted text alone; placeholders stay as they are."""
    turns = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t.startswith(TURN))
    cut = F.transform(turns, lambda t: F.split(F.substring(t, F.lit(len(TURN) + 1), F.length(t)), r"<\|says\|>", 2))
    return F.transform(cut, lambda c: F.struct(unescaped(F.get(c, F.lit(0))).alias("role"), unescaped(F.get(c, F.lit(1))).alias("text")))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask, in order, nothing between."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")
