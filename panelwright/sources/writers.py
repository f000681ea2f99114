"""Sinks: fixed column order, refusals, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Refused(ValueError):
    """The rows break a rule of the sink."""


def write_csv(df: DataFrame, path: str, columns: list[str], sort: list[str], overwrite: bool = False) -> None:
    """Fixed columns in order, sorted; unknown columns are refused and an existing folder is kept unless told otherwise."""
    extra = sorted(set(df.columns) - set(columns))
    if extra:
        raise Refused(f"columns without a place: {extra}")
    rows = df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    rows.orderBy(*sort).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def without_nul(df: DataFrame) -> DataFrame:
    """U+0000 removed from every string column, with the count of changed cells in nul_cells."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    hit = [F.when(F.col(c).contains("\0"), 1).otherwise(0) for c in strings]
    return df.withColumn("nul_cells", sum(hit[1:], hit[0]) if hit else F.lit(0)).withColumns({c: F.replace(F.col(c), F.lit("\0"), F.lit("")) for c in strings})


def one_row_per(df: DataFrame, key: str) -> DataFrame:
    """The rows, unless a key repeats: then the write is refused."""
    repeated = df.groupBy(key).count().where("count > 1").limit(5).collect()
    if repeated:
        raise Refused(f"repeated {key}: {[r[key] for r in repeated]}")
    return df


def content_digest(df: DataFrame) -> str:
    """A digest of the rows as a multiset: equal for equal rows in any order, gathered as one number per partition."""
    rows = df.select(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(20,0)").alias("h"))
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("s"), F.expr("bit_xor(cast(h as bigint))").alias("x")).first()
    return f"{got['n']}-{got['s'] or 0}-{got['x'] or 0}"


def refresh(df: DataFrame, path: str, previous_digest: str | None) -> tuple[str, bool]:
    """Overwrite a materialised view only if its rows changed; the digest and whether it was written."""
    digest = content_digest(df)
    changed = digest != previous_digest
    if changed:
        df.write.mode("overwrite").parquet(path)
    return digest, changed


def expanded(df: DataFrame, legacy: list[str], added: list[str]) -> DataFrame:
    """Additive schema evolution: the legacy columns first, then the added ones, null where the rows lack them."""
    order = list(dict.fromkeys([*legacy, *added]))
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in order])


def sha256sums(df: DataFrame, name: str, content: str) -> DataFrame:
    """Lines as sha256sum -c reads them."""
    return df.select(F.format_string("%s  %s", F.sha2(F.col(content), 256), F.col(name)).alias("value"))


def write_snapshot_csv(df: DataFrame, path: str, at: str, key: str = "uid") -> None:
    """The snapshot as CSV sorted by its key, with a '# snapshot_at=' line; see readers.snapshot_csv.

    The line, and the header again, stand in a file of their own beside the rows: no one task has to write them all.
    """
    write_csv(df, path, df.columns, [key])
    stamp = df.sparkSession.createDataFrame([(f"# snapshot_at={at}\n" + ",".join(df.columns),)], "value string")
    stamp.coalesce(1).write.mode("append").text(path)


def write_json_lines(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """One JSON object per line, nulls written; an existing folder is kept unless told otherwise."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_artifacts(df: DataFrame, path: str) -> None:
    """JSON lines, each file gzipped; a file is there as a whole or not at all (Spark's commit)."""
    df.write.option("compression", "gzip").json(path)


def write_in_draw_order(frame: DataFrame, path: str, columns: list[str]) -> None:
    """A frame as CSV in draw order: files, and rows in them, ascend by draw_pos."""
    write_csv(frame, path, columns, ["draw_pos"])


def write_report(rows: DataFrame, path: str, key: str) -> None:
    """Outcomes as path/jsonl and path/csv, each key once."""
    one_row_per(rows, key)
    write_json_lines(rows, f"{path}/jsonl")
    write_csv(rows, f"{path}/csv", rows.columns, [key])


def inventory(files: DataFrame, shards: DataFrame, run_id: str) -> DataFrame:
    """Lines of a bundle's inventory, as JSON: one for the run, one per shard (shard, files, bytes), one per file (path, bytes, sha256)."""
    whole = shards.agg(F.lit(run_id).alias("run_id"), F.count(F.lit(1)).alias("n_shards"), F.sum("bytes").alias("bytes"))
    kinds = (("run", whole), ("shard", shards), ("file", files))
    lines = [df.select(F.to_json(F.struct(F.lit(kind).alias("kind"), *df.columns)).alias("value")) for kind, df in kinds]
    return lines[0].union(lines[1]).union(lines[2])


def write_run(path: str, version: int, tables: dict[str, tuple[DataFrame, list[str], list[str]]], checks: dict[str, DataFrame], overwrite: bool = False) -> None:
    """A run's tables as path/<name>_v<version>.csv: name -> (rows, columns in order, sort columns).

    Nothing is written where a check (name -> offending rows) finds a row, or
    where any of the tables is there already, unless told to overwrite.
    """
    broken = [name for name, bad in checks.items() if not bad.isEmpty()]
    if broken:
        raise Refused(f"integrity: {broken}")
    spark = next(iter(tables.values()))[0].sparkSession
    where = {name: f"{path}/{name}_v{version}.csv" for name in tables}
    if not overwrite:
        there = [w for w in where.values() if exists(spark, w)]
        if there:
            raise Refused(f"already written: {there}")
    for name, (rows, columns, sort) in tables.items():
        write_csv(without_nul(rows).drop("nul_cells"), where[name], columns, sort, overwrite)


def exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
