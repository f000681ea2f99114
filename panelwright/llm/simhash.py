"""SimHash fingerprints and near-duplicate components by pigeonring filtering.

The 64 bits are a ring of ten segments. If two fingerprints differ in at most
four bits, some segment starts a chain in which, for every length l, the first
l segments differ in at most floor(4 l / 10) bits together: nothing in the
first two, at most one in the first four, two in the first seven, three in
the first nine. Hence the first two agree, and of the next five enough agree
that one of five pairs does: fifty keys of four segments (about 25 bits) find
every link. A pair that meets in a key must keep the chain's budgets before
its whole distance is counted.

Scale: equal fingerprints are one row from the start, with a map-side minimum.
Keys that only one fingerprint has are dropped in the shuffle that builds
them. Inside a key all are first tested against one pivot; only in keys whose
components still differ do pairs meet in a join, so a dense group of near
copies costs links to pivots, not all its pairs. A key that a large group
shares would gather it in one task, so such keys are looked for in a sample
(one fingerprint in HOT_SAMPLE; at most HOT_MOST keys a slot, a fixed bound)
and get their pivots by map-side minima and a broadcast instead. The sample
only chooses the way; either way finds the same links.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import components
from .common import cut, sliced, small_batches, written

SHINGLE, SEED, MOST = 4, 42, 4
HOT_SAMPLE, HOT_LEAST, HOT_MOST = 16, 32, 2000
WIDTHS = (6, 6, 6, 6, 7, 6, 6, 7, 7, 7)
#: Of the chain's segments 2 to 6, pairs of which one always agrees.
PAIRS = ((2, 3), (2, 4), (2, 5), (3, 4), (3, 5))
#: Chain length and bits that may differ in it; lengths between follow from these.
BUDGETS = ((4, 1), (7, 2), (9, 3))

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_BLOCK = 1 << 16


def _mask(start: int, places) -> int:
    """The bits of the segments at these places of the chain, as a signed 64-bit number."""
    starts = [0, *accumulate(WIDTHS)]
    bits = 0
    for k in places:
        s = (start + k) % len(WIDTHS)
        bits |= ((1 << WIDTHS[s]) - 1) << starts[s]
    return bits - (1 << 64) if bits >> 63 else bits


def fingerprint(text: bytes) -> int:
    """The fingerprint of a text's UTF-8 bytes, as a signed 64-bit number."""
    words = text.translate(_LOWER).split()  # ASCII white space: 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        stop = min(at + _BLOCK, n)
        starts = ends[at - 1 : stop - 1] if at else [0, *ends[: stop - 1]]
        hashes = [digest(line[s : e - 1], SEED) for s, e in zip(starts, ends[at + width - 1 : stop + width - 1])]
        counts += np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, keys: list[Column], text: Column) -> DataFrame:
    """The key columns and fp (long). Null texts count as empty."""
    rows = small_batches(docs).select(*keys, text.alias("text_"))
    names = rows.columns[:-1]

    def score(batches):
        for batch in sliced(batches):
            texts = batch.column(len(names)).cast(pa.binary()).to_pylist()
            prints = pa.array([fingerprint(t or b"") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), prints], [*names, "fp"])

    return rows.mapInArrow(score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]) + ", fp long")


def _near(a: Column, b: Column, start: Column) -> Column:
    """The chain from this start keeps its budgets, and then the whole distance does."""
    differ = a.bitwiseXOR(b)
    n = len(WIDTHS)
    ok = F.lit(True)
    for length, most in BUDGETS:
        masks = F.array(*[F.lit(_mask(s, range(length))).cast("long") for s in range(n)])
        ok = ok & (F.bit_count(differ.bitwiseAND(F.get(masks, start))) <= most)
    return ok & (F.bit_count(differ) <= MOST)


def linked(prints: DataFrame) -> DataFrame:
    """(fp, root) for the distinct fingerprints that have a link; root names the component."""
    keys = [F.struct(F.lit(s * len(PAIRS) + k).alias("slot"), F.col("fp").bitwiseAND(F.lit(_mask(s, (0, 1, *pair))).cast("long")).alias("key")) for s in range(len(WIDTHS)) for k, pair in enumerate(PAIRS)]
    start = (F.col("slot") / len(PAIRS)).cast("int")
    keyed = lambda rows: rows.select("fp", F.explode(F.array(*keys)).alias("at")).select("fp", "at.slot", "at.key")
    sampled = cut(prints.where(F.pmod(F.xxhash64("fp"), F.lit(HOT_SAMPLE)) == 0).select("fp"))
    enough = max(HOT_LEAST, sampled.count() // HOT_MOST)
    hot = written(keyed(sampled).groupBy("slot", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= enough).select("slot", "key"), "hot")  # HOT_MOST rows a slot at most
    pivots = written(keyed(prints).join(F.broadcast(hot), ["slot", "key"]).groupBy("slot", "key").agg(F.min("fp").alias("pivot")), "pivots")
    group = Window.partitionBy("slot", "key")
    cold = keyed(prints).join(F.broadcast(hot), ["slot", "key"], "left_anti").withColumn("pivot", F.min("fp").over(group)).withColumn("last", F.max("fp").over(group)).where("pivot < last").drop("last")
    shared = cut(cold.select("slot", "key", "fp", "pivot").union(keyed(prints).join(F.broadcast(pivots), ["slot", "key"]).select("slot", "key", "fp", "pivot")))
    stars = shared.where(F.col("fp") > F.col("pivot")).where(_near(F.col("fp"), F.col("pivot"), start)).select(F.col("fp").alias("u"), F.col("pivot").alias("v")).distinct()
    stars = cut(stars)
    known = cut(components(stars))
    placed = shared.join(known.withColumnRenamed("node", "fp"), "fp", "left").select("slot", "key", "fp", F.coalesce("root", "fp").alias("comp"))
    placed = cut(placed)
    mixed = placed.groupBy("slot", "key").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("slot", "key")
    placed = cut(placed.join(mixed, ["slot", "key"], "left_semi"))
    a, b = placed.alias("a"), placed.alias("b")
    met = (F.col("a.slot") == F.col("b.slot")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.comp") != F.col("b.comp"))
    across = a.join(b, met & _near(F.col("a.fp"), F.col("b.fp"), (F.col("a.slot") / len(PAIRS)).cast("int"))).select(F.col("a.comp").alias("u"), F.col("b.comp").alias("v"))
    joined = cut(across.distinct())
    return components(stars.union(joined)).withColumnRenamed("node", "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least id reachable over links, itself included), keeper.

    - Texts are lower-cased (A-Z), cut at ASCII white space and read in
      4-word shingles, repeats included; fewer words are one shingle; no
      words (null or empty texts) give fingerprint 0, linked like any other.
    - keeper: the row has its component's least (id, fingerprint); rows
      equal in both are all keepers.
    - Repeated rows get a row each; a null id never is a component's id
      unless all are null; an empty table gives no rows; other columns are
      not read.
    """
    prints = cut(fingerprints(docs, [F.col(id_col).alias("doc_id")], F.col(text_col)))
    distinct = cut(prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("least")))
    roots = written(distinct.join(linked(distinct.select("fp")), "fp", "left"), "roots")
    alone = roots.where("root IS NULL").select("fp", F.col("least").alias("kept"))
    grouped = roots.where("root IS NOT NULL")
    least = written(grouped.groupBy("root").agg(F.min("least").alias("kept")), "least")
    named = alone.union(grouped.join(least, "root").select("fp", "kept"))
    same = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("fp") == F.col("kept.fp"))
    return prints.join(named, "fp").select("doc_id", "fp", F.col("kept.doc_id").alias("component_id"), same.alias("keeper"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component the document with the least (id, fingerprint), with all its columns.

    Rows are told apart by id alone, so nothing hangs on the order of a scan.
    Ids that several rows share, some of them kept, are settled apart by
    fingerprint; of rows equal in both the least by its JSON form stays.
    """
    found = cut(near_duplicates(docs, id_col, text_col))
    ids = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("keeper").alias("any"))
    settled = written(ids.where("n > 1 OR NOT any"), "settled").withColumnRenamed("doc_id", "id_of_near_copies")
    same = F.col(id_col).eqNullSafe(F.col("id_of_near_copies"))
    plain = docs.join(settled.drop("n", "any"), same, "left_anti")
    mixed = docs.join(settled.where("any").drop("n", "any"), same, "left_semi")
    printed = fingerprints(mixed, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")], F.col(text_col)).withColumn("id", F.col(f"row.`{id_col}`"))
    kept = found.where("keeper").select(F.col("doc_id").alias("kept_id"), F.col("fp").alias("kept_fp")).distinct()
    chosen = printed.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")), "left_semi")
    return plain.union(chosen.groupBy("id", "fp").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
