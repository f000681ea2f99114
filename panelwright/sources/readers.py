"""Readers: every one states its schema; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER = "ts string, institution_id string, stage string, reason string, url string, detail string"
EVENTS = "ts string, run_id string, session_id string, git_sha string, seq long, event string, stage string, payload map<string,string>"
STAGE_TIME = "start_time string, end_time string, duration_seconds double, status string"


class MissingColumns(ValueError):
    """A file lacks columns that its reader requires."""


def strings_csv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A CSV with header, every cell a string, cells of any length; refuses a file without the required columns."""
    header = spark.read.option("header", True).option("maxCharsPerColumn", -1).option("multiLine", True).option("escape", '"').csv(path, inferSchema=False)
    lacking = [c for c in required if c not in header.columns]
    if lacking:
        raise MissingColumns(f"{path} lacks {lacking}")
    return header


def with_row_index(df: DataFrame, name: str = "row_index") -> DataFrame:
    """Rows numbered from 0 in scan order by per-partition counts and offsets; only the counts are gathered by a window."""
    placed = df.withColumn("part_", F.spark_partition_id()).withColumn("pos_", F.monotonically_increasing_id())
    offsets = placed.groupBy("part_").agg(F.count(F.lit(1)).alias("n_"), F.min("pos_").alias("first_")).withColumn("offset_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(offsets.select("part_", "first_", "offset_"), "part_").withColumn(name, F.col("offset_") + F.col("pos_") - F.col("first_")).drop("part_", "pos_", "first_", "offset_")


def rows_at(df: DataFrame, wanted: DataFrame, index: str = "row_index") -> DataFrame:
    """The rows whose index is wanted (index, draw_pos), in draw order."""
    return df.join(wanted, index).orderBy("draw_pos")


def json_lines(spark: SparkSession, path: str, schema: str = LEDGER, strict: bool = True) -> DataFrame:
    """A JSON-lines ledger; strict: a bad line fails the read, else it is skipped (as a torn last line of a log)."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, plain or gzip; of two files with one stem the compressed one is read."""
    found = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json*").option("recursiveFileLookup", True).json(path).withColumn("file", F.col("_metadata.file_path"))
    stem = F.regexp_replace("file", r"\.json(\.gz)?$", "")
    return found.withColumn("first_", F.max("file").over(Window.partitionBy(stem))).where("file = first_").drop("first_")


def snapshot_csv(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """An inspection snapshot and its stamp from the '# snapshot_at=' line above the header."""
    stamp = spark.read.text(path).where(F.col("value").startswith("# snapshot_at=")).select(F.substring_index("value", "=", -1).alias("at")).first()
    rows = spark.read.option("header", True).option("comment", "#").csv(path)
    return rows, stamp["at"] if stamp else None


def jdbc_sweeps(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The sweeps query pushed down to a database."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def stage_times(timings: DataFrame) -> DataFrame:
    """(institution_id, stage, start_time, ...) from documents with a map of stages."""
    return timings.select("institution_id", F.explode("stages").alias("stage", "t")).select("institution_id", "stage", "t.*")


def shard_census(spark: SparkSession, path: str) -> DataFrame:
    """(shard, files, bytes) by directory, from file metadata alone."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return listed.groupBy(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("shard")).agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))


@F.pandas_udf(T.BooleanType())
def is_docx(content):
    """The body is a ZIP package that holds a DOCX document part; only bodies with a ZIP signature are opened."""
    import io
    import zipfile

    def test(data):
        if not data or not bytes(data[:4]) == b"PK\x03\x04":
            return False
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as packed:
                return "word/document.xml" in packed.namelist()
        except (zipfile.BadZipFile, ValueError, OSError):
            return False

    return content.map(test)


def kind_of(content: Column, content_type: Column, url: Column) -> Column:
    """Route of a fetched body: pdf or docx by its bytes, else pdf by its declared type or its URL, else html.

    A PDF's mark stands in the first 1024 bytes with no "<" before it.
    """
    head = F.decode(F.substring(content, 1, 1024), "ISO-8859-1")
    pdf = F.coalesce(head.contains("%PDF-") & ~F.substring_index(head, "%PDF-", 1).contains("<"), F.lit(False))
    declared = F.coalesce(F.lower(content_type).contains("pdf"), F.lit(False)) | F.coalesce(F.lower(url).endswith(".pdf"), F.lit(False))
    return F.when(pdf, "pdf").when(is_docx(content), "docx").when(declared, "pdf").otherwise("html")


@F.pandas_udf(T.StringType())
def docx_text(content):
    """One line per paragraph of a DOCX body; null for what is none."""
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(data):
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as packed:
                root = ElementTree.fromstring(packed.read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))

    return content.map(read)


def tar_members(files: DataFrame) -> DataFrame:
    """(path, member, size, sha256) of every file inside tar archives (path, content)."""
    import pandas as pd

    def unpack(frames):
        import hashlib
        import io
        import tarfile

        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    rows = [(path, m.name, m.size, hashlib.sha256(tar.extractfile(m).read()).hexdigest()) for m in tar if m.isfile()]
                yield pd.DataFrame(rows, columns=["path", "member", "size", "sha256"])

    return files.select("path", "content").mapInPandas(unpack, "path string, member string, size long, sha256 string")
