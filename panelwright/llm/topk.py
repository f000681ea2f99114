"""Exact top-k inner products over a pivot-distance index.

A vector x of length at most M is lifted to (x, sqrt(M^2 - |x|^2)); a query q
to (q, 0). Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the largest products
are the nearest neighbours. Index: every vector is keyed by its nearest pivot
and its distance to it, sorted, and packed into blocks: each block is an
annulus (pivot, dmin, dmax). For a query at distance d from the pivot no
vector of the annulus can be nearer than the gap between d and [dmin, dmax]
(triangle inequality), which bounds its product from above.

Search, for blocks of queries: first an annulus near to the block in its own
pivot's list (of each of CELLS distances one annulus is a seat) gives each
query a k-th score that the answer reaches at least; then only annuli whose
bound reaches that score are expanded, in order of their bounds. A tie can
still win by its id, so only a bound strictly below the k-th score stops. All
scores are integers computed exactly; beyond 64 bits they stop at the ends of
a long.

Pivots are a bounded sample (SAMPLE rows); every row is indexed. Blocks are
packed by tasks over a range-partitioned table, whose range includes the id,
so equal vectors spread. What joins are blocks, never rows. A floor bounds the
distance at which an annulus can matter, so query and index blocks meet in
cells of that distance: a pair that the bound excludes is not even made, as
far as whole cells tell. A query block travels once to each strip of annuli.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, PIVOTS, BLOCK, QUERY_BLOCK, STRIP, CELLS = 2000, 32, 2048, 1024, 32, 64
LEAST, MOST = -(2**63), 2**63 - 1
ROWS = "dim int, pivot int, dist double, vec_id long, vec binary"
BLOCKS = "dim int, pivot int, block long, dmin double, dmax double, ids binary, vecs binary"
ASKED = "dim int, qpivot int, qblock long, longest_q double, near array<double>, far array<double>, qids binary, qvecs binary"


def quantized(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as long, at most a long's ends; null where it is null or holds null or non-finite components."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = lambda x: F.floor(F.least(F.greatest(F.lit(float(scale)) * x.cast("double"), F.lit(-(2.0**63))), F.lit(2.0**63 - 1024)))
    return F.when(good & (F.size(embedding) > 0), F.transform(embedding, whole))


def _pivots(vectors: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """Per dimension the lifted pivots and M squared: M by an aggregate over all rows, rounded up; pivots by farthest-first on the sample."""
    norm = F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    lengths = {r["dim"]: r["m"] * (1 + 1e-12 * r["dim"]) for r in vectors.groupBy("dim").agg(F.max(norm).alias("m")).collect()}  # one row per dimension
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(SAMPLE).select("dim", "vec").collect()
    out = {}
    for dim, longest in lengths.items():
        own = np.array([r["vec"] for r in sample if r["dim"] == dim], float).reshape(-1, dim)
        if not len(own):
            own = np.zeros((1, dim))
        lifted = np.hstack([own, np.sqrt(np.maximum(longest - (own**2).sum(1), 0))[:, None]])
        chosen, far = [0], ((lifted - lifted[0]) ** 2).sum(1)
        while len(chosen) < min(PIVOTS, len(lifted)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
        out[dim] = (lifted[chosen], float(longest))
    return out


def _distances(vecs: np.ndarray, pivots: np.ndarray, last: np.ndarray) -> np.ndarray:
    lifted = np.hstack([vecs.astype(float), last[:, None]])
    return np.sqrt(np.maximum((lifted**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * lifted @ pivots.T, 0))


def _keyed(vectors: DataFrame, pivots: dict, lift: bool) -> DataFrame:
    """ROWS: each vector with its nearest pivot and the distance to it."""

    def key(batches):
        for batch in batches:
            dims, lists = np.array(batch.column(1)), batch.column(2)
            begins = np.array(lists.offsets)[:-1] - lists.offsets[0].as_py()
            numbers = np.array(lists.flatten())
            pivot, dist = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                points, longest = pivots[int(dim)]
                vecs = numbers[begins[rows, None] + np.arange(dim)]
                last = np.sqrt(np.maximum(longest - (vecs.astype(float) ** 2).sum(1), 0)) if lift else np.zeros(len(rows))
                away = _distances(vecs, points, last)
                pivot[rows] = away.argmin(1)
                dist[rows] = away.min(1)
            ends = 8 * np.append(begins, len(numbers))
            packed = pa.Array.from_buffers(pa.large_binary(), len(dims), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(numbers)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(pivot), pa.array(dist), batch.column(0), packed], ["dim", "pivot", "dist", "vec_id", "vec"])

    return vectors.select("vec_id", "dim", "vec").mapInArrow(key, ROWS)


def _small(vecs: np.ndarray) -> bool:
    return not vecs.size or -(2**15) <= vecs.min() <= vecs.max() < 2**15


def _bytes(vecs: np.ndarray) -> bytes:
    """Two bytes a component where that is enough, else eight."""
    return vecs.astype(np.int16 if _small(vecs) else np.int64).tobytes()


def _vectors(data: bytes, n: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int16 if len(data) == 2 * n * dim else np.int64).reshape(n, dim).astype(np.int64)


def _packed(rows: DataFrame, size: int, schema: str, shape) -> DataFrame:
    """Blocks of at most ``size`` neighbours in (dim, pivot, dist, id) order; memory holds one block."""
    order = ("dim", "pivot", "dist", "vec_id")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def pack(batches):
        held: list[pa.RecordBatch] = []
        group, count = None, 0

        def blocks(enough: int):
            """The held rows, in blocks, as long as there are so many."""
            nonlocal held, count
            table = pa.Table.from_batches(held)
            at = 0
            while table.num_rows - at >= enough:
                own = table.slice(at, size).combine_chunks()
                at += own.num_rows
                dim, pivot = group
                vecs = np.frombuffer(b"".join(own.column("vec").to_pylist()), np.int64).reshape(-1, dim)
                ids, dist = own.column("vec_id").to_numpy(), own.column("dist").to_numpy()
                yield pd.DataFrame([shape(dim, pivot, (own.column("part")[0].as_py() << 32) + count, float(dist[0]), float(dist[-1]), ids, vecs)], columns=[c.split(" ")[0] for c in schema.split(", ")])
                count += 1
            held = table.slice(at).to_batches()

        for batch in batches:
            keys = np.stack([batch.column("dim").to_numpy(), batch.column("pivot").to_numpy()], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                own = (int(keys[start, 0]), int(keys[start, 1])) if end > start else group
                if held and own != group:
                    yield from blocks(1)
                group = own
                held.append(batch.slice(start, end - start))
                if sum(h.num_rows for h in held) >= size:
                    yield from blocks(size)
        if held:
            yield from blocks(1)

    types = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}[t]) for n, t in (c.split(" ") for c in schema.split(", "))])

    def packed(batches):
        for frame in pack(batches):
            yield pa.RecordBatch.from_pandas(frame, types, preserve_index=False)

    return ordered.mapInArrow(packed, schema)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    keep = np.arange(len(score))
    if len(score) > 4 * k:
        keep = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return keep[np.lexsort((ids[keep], ~score[keep]))[:k]]  # ~x: -x - 1, without overflow


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond 64 bits they stop at a long's ends."""
    dim = queries.shape[1]
    most_q, most_x = np.abs(queries.astype(float)).max(1, initial=0), np.abs(data.astype(float)).max(1, initial=0)
    most = most_q.max(initial=0) * most_x.max(initial=0) * dim
    if most < 2**52:
        return (queries.astype(float) @ data.T.astype(float)).astype(np.int64)
    if most < 2**62:
        return queries @ data.T
    out = np.empty((len(queries), len(data)), np.int64)
    bound = np.where(most_q > 0, 2.0**61 / np.maximum(most_q * dim, 1e-300), np.inf)
    for r, q in enumerate(queries):  # only products that may leave 64 bits are taken in whole numbers
        wide = most_x >= bound[r]
        out[r, ~wide] = data[~wide] @ q
        out[r, wide] = [max(LEAST, min(MOST, sum(a * b for a, b in zip(q.tolist(), x)))) for x in data[wide].tolist()]
    return out


def _slack(square):
    """How far a distance may be off by rounding, given the sum of the squares that it comes from."""
    return 1e-6 + 1e-6 * np.sqrt(square)


def _reach(queries: np.ndarray, points: np.ndarray, longest: float, pivot: int, dmin: float, dmax: float) -> np.ndarray:
    """Per query an upper bound of its products with the annulus."""
    d = _distances(queries, points[pivot : pivot + 1], np.zeros(len(queries)))[:, 0]
    square = (queries.astype(float) ** 2).sum(1)
    gap = np.maximum(np.maximum(dmin - d, d - dmax) - _slack(square + longest), 0)
    return (square + longest - gap**2) / 2 + 1e-3 + 1e-9 * (square + longest)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products, ties to smaller ids.

    Both sides hold vec_id and vec (array<long>, see quantized). Null vectors
    and ids take no part; rows with the query's own id are no candidates for
    it; a repeated query id is asked once, with its least vector; other repeated rows are candidates
    of their own; vectors meet only those of their own dimension; fewer
    candidates give fewer rows; empty sides give none.
    """
    spark = vectors.sparkSession

    def usable(df):
        return df.where("vec IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "vec", F.size("vec").alias("dim"))

    vectors, queries = usable(vectors), usable(queries.where("vec IS NOT NULL").groupBy("vec_id").agg(F.min("vec").alias("vec")))
    pivots = _pivots(vectors)
    queries = queries.where(F.col("dim").isin([*pivots, -1]))

    def ring(dim, pivot, block, dmin, dmax, ids, vecs):
        return dim, pivot, block, dmin, dmax, ids.tobytes(), _bytes(vecs)

    def question(dim, pivot, block, dmin, dmax, ids, vecs):
        away = _distances(vecs, pivots[dim][0], np.zeros(len(vecs)))
        return dim, pivot, block, float((vecs.astype(float) ** 2).sum(1).max()), away.min(0).tolist(), away.max(0).tolist(), ids.tobytes(), _bytes(vecs)

    index = written(_packed(_keyed(vectors, pivots, True), BLOCK, BLOCKS, ring), "annuli")
    asked = written(_packed(_keyed(queries, pivots, False), QUERY_BLOCK, ASKED, question), "asked")

    def by_dim(values: dict, default: float) -> Column:
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in {-1: default, **values}.items() for x in pair]), F.col("dim")), F.lit(default))

    longest = by_dim({d: m for d, (_, m) in pivots.items()}, 0.0)
    width = by_dim({d: max(2 * m**0.5 / CELLS, 1e-3) for d, (_, m) in pivots.items()}, 1.0)
    cell = lambda d: F.floor(F.least(d / F.col("width"), F.lit(1e9)))

    # Round 1: of the block's own pivot the seat nearest to it sets each query's floor.
    gap = F.greatest(F.col("dmin") - F.col("q_far"), F.col("q_near") - F.col("dmax"), F.lit(0.0))
    rings = index.select("dim", "pivot", "block", "dmin", "dmax").withColumn("width", width)
    seats = rings.groupBy("dim", "pivot", cell(F.col("dmin")).alias("cell")).agg(F.min(F.struct("block", "dmin", "dmax")).alias("seat")).select("dim", "pivot", "seat.*")  # PIVOTS * CELLS rows a dimension
    asides = asked.select("dim", "qpivot", "qblock", "longest_q", F.posexplode(F.arrays_zip("near", "far")).alias("pivot", "d")).select("dim", "qpivot", "qblock", "longest_q", "pivot", F.col("d.near").alias("q_near"), F.col("d.far").alias("q_far"))
    close = asides.where("pivot = qpivot").join(seats, ["dim", "pivot"]).groupBy("dim", "qblock").agg(F.min_by("block", F.struct(gap.alias("gap"), "block")).alias("block"))

    def floors(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                ids, near = np.frombuffer(row.qids, np.int64), np.frombuffer(row.ids, np.int64)
                score = _products(_vectors(row.qvecs, len(ids), row.dim), _vectors(row.vecs, len(near), row.dim))
                score[ids[:, None] == near[None]] = LEAST
                floor = np.partition(score, len(near) - k, axis=1)[:, len(near) - k] if len(near) >= k else np.full(len(ids), LEAST)
                out.append((row.dim, row.qblock, float(floor.min()), floor.tobytes()))
            yield pd.DataFrame(out, columns=["dim", "qblock", "floor", "floors"]).astype({"dim": "int32"})

    paired = asked.select("dim", "qblock", "qids", "qvecs").join(close, ["dim", "qblock"]).join(index.select("dim", "block", "ids", "vecs"), ["dim", "block"])
    floor = written(paired.mapInPandas(floors, "dim int, qblock long, floor double, floors binary"), "floors")

    # Round 2: only the pairs whose bound reaches a floor are made, and only their blocks move.
    total = F.col("longest_q") + longest
    slack = 1e-6 + 1e-6 * F.sqrt(total)
    bound = (total - F.pow(F.greatest(gap - slack, F.lit(0.0)), 2)) / 2 + 1e-3 + 1e-9 * total
    # bound >= floor holds for gaps of at most ``far``.
    far = F.sqrt(F.greatest(total * (1 + 2e-9) + 2e-3 - 2 * F.col("floor"), F.lit(0.0))) * (1 + 1e-9) + slack + 1e-3
    strips = max(1, -(-index.count() // STRIP))
    meant = asides.join(floor.select("dim", "qblock", "floor"), ["dim", "qblock"]).withColumn("width", width).withColumn("far", far)
    meant = meant.withColumn("first", F.greatest(cell(F.col("q_near") - F.col("far")), F.lit(0))).withColumn("end", F.least(F.greatest(cell(F.col("q_far") + F.col("far")), F.lit(0)), F.lit(2 * CELLS)))
    cells = F.explode(F.sequence("first", "end"))
    lowest, highest = (F.least(cell(F.col(c)), F.lit(2 * CELLS)) for c in ("dmin", "dmax"))
    spread = rings.withColumn("lowest", lowest).withColumn("cell", F.explode(F.sequence("lowest", highest))).drop("width")
    pairs = meant.withColumn("cell", cells).join(spread, ["dim", "pivot", "cell"]).where(F.col("cell") == F.greatest("first", "lowest")).withColumn("bound", bound).where("bound >= floor").select("dim", "qblock", "pivot", "block", "dmin", "dmax", "bound", F.pmod(F.xxhash64("block"), F.lit(strips)).alias("strip"))
    pairs = written(pairs, "pairs")
    annuli = pairs.join(index.select("dim", "block", "ids", "vecs"), ["dim", "block"]).select("dim", "qblock", "strip", F.lit(1).alias("kind"), "bound", "pivot", "block", "dmin", "dmax", "ids", "vecs", F.lit(None).cast("binary").alias("floors"))
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("bound", "double"), ("pivot", "int"), ("block", "long"), ("dmin", "double"), ("dmax", "double"))]
    blocks = pairs.select("dim", "qblock", "strip").distinct().join(asked.select("dim", "qblock", "qids", "qvecs"), ["dim", "qblock"]).join(floor.select("dim", "qblock", "floors"), ["dim", "qblock"]).select("dim", "qblock", "strip", F.lit(0).alias("kind"), *nothing, F.col("qids").alias("ids"), F.col("qvecs").alias("vecs"), "floors")
    dealt = annuli.unionByName(blocks).repartition("dim", "qblock", "strip").sortWithinPartitions("dim", "qblock", "strip", "kind", F.col("bound").desc(), "block")

    def search(frames):
        """A running top k for each query of the block at hand, best bounds first; the block itself comes before its annuli."""
        held = False

        def done():
            return pd.DataFrame({"query_id": np.repeat(ids, [len(f) for f in found]), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

        for frame in frames:
            for row in frame.itertuples(index=False):
                if row.kind == 0:
                    if held:
                        yield done()
                    held = True
                    ids = np.frombuffer(row.ids, np.int64)
                    vecs = _vectors(row.vecs, len(ids), row.dim)
                    least = np.frombuffer(row.floors, np.int64).copy()
                    scores, found = [np.zeros(0, np.int64) for _ in ids], [np.zeros(0, np.int64) for _ in ids]
                    continue
                points, longest_x = pivots[row.dim]
                rows = np.flatnonzero(_reach(vecs, points, longest_x, int(row.pivot), row.dmin, row.dmax) >= least)
                if not len(rows):
                    continue
                near = np.frombuffer(row.ids, np.int64)
                product = _products(vecs[rows], _vectors(row.vecs, len(near), row.dim))
                fits = (product >= least[rows, None]) & (near[None] != ids[rows, None])
                for at in np.flatnonzero(fits.any(1)):
                    r, pick = rows[at], np.flatnonzero(fits[at])
                    score, who = np.concatenate([scores[r], product[at, pick]]), np.concatenate([found[r], near[pick]])
                    best = _best(score, who, k)
                    scores[r], found[r] = score[best], who[best]
                    if len(best) == k:
                        least[r] = max(least[r], score[best[-1]])
        if held:
            yield done()

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return dealt.mapInPandas(search, "query_id long, vec_id long, score long").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
