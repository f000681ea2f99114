"""The six rules that combine the answers of a unit's parts into one.

Input: answers(unit, part, part_id, value, probability, failed). Parts that
answer NOT_COVERED do not vote; a failed answer votes as 'unknown' and is no
real value. Without a real value the missing ones compete: 'not_documented'
before 'unknown'; without any vote the unit is 'not_documented'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the vocabulary.
NOT_COVERED, NOT_DOCUMENTED, UNKNOWN = "not covered by this part", "not_documented", "unknown"


def votes(answers: DataFrame) -> DataFrame:
    entered = F.when(F.col("failed"), UNKNOWN).otherwise(F.col("value"))
    real = ~F.col("failed") & ~F.col("value").isin(NOT_DOCUMENTED, UNKNOWN)
    return answers.where(F.col("value").isNotNull()).withColumn("covered", F.col("value") != NOT_COVERED).withColumn("entered", F.when(F.col("covered"), entered)).withColumn("real", F.col("covered") & real)


def _fallback() -> Column:
    documented = F.coalesce(F.bool_or((F.col("entered") == NOT_DOCUMENTED) & F.col("covered")), F.lit(False))
    unknown = F.coalesce(F.bool_or((F.col("entered") == UNKNOWN) & F.col("covered")), F.lit(False))
    return F.when(documented, NOT_DOCUMENTED).when(unknown, UNKNOWN).otherwise(NOT_DOCUMENTED)


def _picked(answers: DataFrame, value: Column) -> DataFrame:
    return votes(answers).groupBy("unit").agg(value.alias("picked"), _fallback().alias("missing")).select("unit", F.coalesce("picked", "missing").alias("value"))


def _if_real(column: Column) -> Column:
    return F.when(F.col("real"), column)


def priority_order(answers: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """The vote that comes first in the order; missing tokens take part where the order names them."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("entered"))
    best = F.min_by("entered", F.when(F.col("covered") & (rank > 0), rank))
    return votes(answers).groupBy("unit").agg(F.when(F.bool_or(F.col("covered") & (rank > 0)), best).alias("picked"), _fallback().alias("missing")).select("unit", F.coalesce("picked", "missing").alias("value"))


def any_yes(answers: DataFrame) -> DataFrame:
    return priority_order(answers, ("yes", "no", NOT_DOCUMENTED, UNKNOWN))


def first_section(answers: DataFrame) -> DataFrame:
    return _picked(answers, F.min_by("entered", _if_real(F.col("part"))))


def earliest_year(answers: DataFrame) -> DataFrame:
    return _picked(answers, F.min(_if_real(F.col("entered").try_cast("int"))).cast("string"))


def highest_probability(answers: DataFrame) -> DataFrame:
    """The surest real answer; ties go to the lower part."""
    return _picked(answers, F.max_by("entered", _if_real(F.struct("probability", (-F.col("part")).alias("p")))))


def combined_list(answers: DataFrame, both: tuple[str, str, str] | None = None) -> DataFrame:
    """Distinct real values in part order, joined by '|'; both=(a, b, c): a list of a and b is c."""
    found = votes(answers).groupBy("unit").agg(F.array_sort(F.collect_list(_if_real(F.struct("part", "entered")))).alias("l"), _fallback().alias("missing"))
    values = F.array_distinct(F.transform("l", lambda x: x["entered"]))
    if both:
        a, b, c = both
        values = F.when((F.array_contains(values, a) & F.array_contains(values, b)) | F.array_contains(values, c), F.array(F.lit(c))).otherwise(values)
    return found.select("unit", F.when(F.size(values) > 0, F.array_join(values, "|")).otherwise(F.col("missing")).alias("value"))


def confidence_quorum(sources: DataFrame) -> DataFrame:
    """(activity, confidence): high if any source is, or if two independent groups are medium; else the highest; unknown counts low."""
    rank = F.when(F.col("confidence") == "high", 2).when(F.col("confidence") == "medium", 1).otherwise(0)
    quorum = F.count_distinct(F.when(rank == 1, F.col("independence_group"))) >= 2
    best = F.max(rank)
    return sources.groupBy("activity").agg(F.when((best == 2) | quorum, "high").when(best == 1, "medium").otherwise("low").alias("confidence"))


def best_confidence(rows: DataFrame) -> DataFrame:
    """(unit, confidence): the ordinal maximum high > medium > low."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).otherwise(0)
    return rows.groupBy("unit").agg(F.max_by("confidence", rank).alias("confidence"))
