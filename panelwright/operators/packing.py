"""Greedy packing by running budgets, and lossless chunking of texts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def greedy_chunks(items: DataFrame, group: str, order: str, size: str, budget: int, most: int | None = None) -> DataFrame:
    """(group, order, chunk): items of a group, in order, packed into chunks (from 0) within a size budget and a count.

    A new chunk starts where the next item would break a limit; an item over
    the budget stands alone; a null size is none. Packing is a walk along each
    group, so a task streams over its sorted (group, order, size) rows and
    holds one running chunk, however long the group is.
    """
    rows = items.select(F.col(group).alias("group"), F.col(order).alias("order"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"))
    kinds = [rows.schema[c].dataType.simpleString() for c in ("group", "order")]
    limit = most or (1 << 62)

    def walk(batches):
        held, chunk, used, n = None, 0, 0, 0
        started = False
        for batch in batches:
            groups, out = batch.column(0).to_pylist(), []
            for own, s in zip(groups, batch.column(2).to_pylist()):
                if not started or own != held:
                    held, chunk, used, n, started = own, 0, 0, 0, True
                if n and (used + s > budget or n >= limit):
                    chunk, used, n = chunk + 1, 0, 0
                used, n = used + s, n + 1
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], ["group", "order", "chunk"])

    placed = rows.repartition("group").sortWithinPartitions("group", "order", "size").mapInArrow(walk, f"`group` {kinds[0]}, `order` {kinds[1]}, chunk int")
    return placed.select(F.col("group").alias(group), F.col("order").alias(order), "chunk")


# Tokens per UTF-8 byte by script are parameters of the estimate.
TOKENS_PER_BYTE = {"latin": 0.30, "cjk": 0.45, "thai": 0.40}
_CJK = r"\x{1100}-\x{11FF}\x{2E80}-\x{2FDF}\x{3000}-\x{33FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}\x{20000}-\x{3FFFF}"


def token_estimate(text: Column, per_byte: dict[str, float] = TOKENS_PER_BYTE) -> Column:
    """Bytes per script times its weight, rounded up."""
    cjk = F.octet_length(F.regexp_replace(text, f"[^{_CJK}]", ""))
    thai = F.octet_length(F.regexp_replace(text, r"[^\x{0E00}-\x{0E7F}]", ""))
    latin = F.octet_length(text) - cjk - thai
    return F.ceil(cjk * per_byte["cjk"] + thai * per_byte["thai"] + latin * per_byte["latin"] - 1e-9)


def chunk_pages(pages: DataFrame, key: str, text: str, chars: int) -> DataFrame:
    """(key, part, start, end, text): each page cut after white space into parts of at most ``chars`` characters; joined again they are the page."""
    pieces = F.regexp_extract_all(F.col(text), F.lit(rf"(?s)(.{{1,{chars}}}(?:\s|$)|.{{1,{chars}}})"), 1)
    pieces = F.filter(pieces, lambda p: p != "")
    each = pages.select(key, pieces.alias("p")).select(key, F.posexplode("p").alias("at", "piece"), F.transform("p", lambda p: F.length(p)).alias("sizes"))
    # Parts are full but for the last, so a part's start is a short sum: pages of up to chars parts stay cheap.
    begin = F.aggregate(F.slice("sizes", F.lit(1), F.col("at")), F.lit(0), lambda acc, n: acc + n)
    return each.select(key, (F.col("at") + 1).alias("part"), begin.alias("start"), (begin + F.length("piece")).alias("end"), F.col("piece").alias("text"))


class OverLimit(Exception):
    """What a ``send`` function raises when a part is too large for it."""


def halves(text: str) -> tuple[str, str]:
    """The text cut at the boundary nearest its middle: a paragraph, else a line, else a sentence, else a space, else the middle."""
    import re

    for pattern in (r"\n[ \t]*\n\s*", r"\n", r"(?<=[.!?。！？])\s+", r"\s+"):
        cuts = [m.end() for m in re.finditer(pattern, text) if 0 < m.end() < len(text)]
        if cuts:
            at = min(cuts, key=lambda p: (abs(p - len(text) / 2), p))
            return text[:at], text[at:]
    return text[: len(text) // 2], text[len(text) // 2 :]


def with_halving(parts: DataFrame, key: str, text: str, send, depth: int = 3) -> DataFrame:
    """(key, piece, result, failed): send(text) -> string for each part; on OverLimit the part is halved and sent again, ``depth`` times at most.

    ``send`` runs in the tasks; pieces come in the text's order; a piece that is
    still over the limit has a null result and failed set.
    """
    import pandas as pd

    def run(frames):
        def tried(piece, left):
            try:
                return [(send(piece), False)]
            except OverLimit:
                if not left or len(piece) < 2:
                    return [(None, True)]
                return [r for half in halves(piece) for r in tried(half, left - 1)]

        for frame in frames:
            rows = [(k, n, r, failed) for k, t in zip(frame["key"], frame["text"]) for n, (r, failed) in enumerate(tried(t or "", depth), 1)]
            yield pd.DataFrame(rows, columns=["key", "piece", "result", "failed"])

    rows = parts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, piece int, result string, failed boolean")
