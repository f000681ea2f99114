"""Session and table helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "panelwright", master: str = "local[*]", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators assume (UTC, AQE)."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
