"""Made panels that Spark and DuckDB read from the same portable SELECT statements."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import table


def rows(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """The statement's rows; {name} stands for one of the driver's tables."""
    names = set(re.findall(r"\{(\w+)\}", statement))
    return spark.sql(statement, **{n: table(spark, sf_dir, n) for n in names})


def plain(statement: str) -> str:
    """The same statement for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", statement)


def ctes(**statements: str) -> str:
    """A WITH clause that names each statement."""
    return "WITH " + ", ".join(f"{name} AS ({plain(s)})" for name, s in statements.items()) + " "


# A consolidated panel: institutions are customers, activities their orders, sources the line items.
INSTITUTIONS = """SELECT c_custkey AS inst, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unclear' END AS verdict,
    'N' || c_nationkey AS country, c_mktsegment AS level, c_custkey % 9 AS n_pages, 'about ' || c_name AS summary FROM {customer}"""
ACTIVITIES = """SELECT o_custkey AS inst, o_orderkey AS pos, 'A' || o_orderkey AS activity_id, 'work ' || (o_orderkey % 5) AS activity_name,
    CASE o_orderkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'chat' WHEN 2 THEN 'code' ELSE 'draft' END AS tool,
    CASE o_orderpriority WHEN '5-LOW' THEN 'unknown' ELSE o_orderpriority END AS vendor,
    CASE o_orderkey % 7 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' ELSE 'low' END AS confidence,
    CASE o_orderkey % 6 WHEN 0 THEN 'b;a' WHEN 1 THEN 'c' WHEN 2 THEN '' ELSE 'none' END AS flags,
    CASE o_orderkey % 3 WHEN 0 THEN 'announced' WHEN 1 THEN 'pilot' ELSE 'production' END AS stage, o_orderkey % 6 AS n_sources FROM {orders}"""
SOURCES = """SELECT o_custkey AS inst, l_orderkey * 10 + l_linenumber AS pos, 'S' || (l_orderkey * 10 + l_linenumber) AS source_id,
    CASE WHEN l_linenumber % 5 = 4 THEN '_NA_' WHEN l_linenumber % 7 = 6 THEN 'A0' ELSE 'A' || l_orderkey END AS activity_id, 'u' || (l_partkey % 60) AS url,
    CASE l_suppkey % 6 WHEN 0 THEN 'It will deploy a chatbot' WHEN 1 THEN 'The office is considering an LLM' WHEN 2 THEN 'Staff of Wellman may adopt forms'
      WHEN 3 THEN 'Are exploring LLMs and Generative tools' WHEN 4 THEN 'plain text' ELSE 'budget of 4 for ChatGPT' END AS snippet,
    CASE l_partkey % 5 WHEN 0 THEN 'confirms_absence' WHEN 1 THEN 'not_assessable' WHEN 2 THEN 'ambiguous' ELSE 'confirms_activity' END AS evidence,
    CASE l_suppkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS credibility, CASE l_returnflag WHEN 'A' THEN 'news' WHEN 'N' THEN 'official' ELSE 'vendor' END AS source_type,
    CASE l_partkey % 4 WHEN 0 THEN 'downgraded_quote' WHEN 1 THEN 'supported' ELSE NULL END AS support
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"""
LEDGER = """SELECT o_custkey AS inst, 'u' || (l_partkey % 60) AS url, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 0 THEN 'salvaged' ELSE 'dropped' END AS reason,
    CASE l_linenumber % 3 WHEN 0 THEN 'x;fields=tool,vendor' WHEN 1 THEN 'x;fields=stage,,action' ELSE 'no list' END AS detail
    FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey WHERE l_suppkey % 4 = 0"""
