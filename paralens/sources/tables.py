"""Readers, and views of general tables that stand in for the study's own inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


#: SQL of the stand-ins, in the words that Spark and other engines share: table, then a select list.
ANSWER = "cast(cast(l_quantity AS BIGINT) * l_linenumber + 1000 AS STRING)"
RESPONSES = f"""l_suppkey AS p, concat(cast(l_orderkey AS STRING), '-', cast(l_linenumber AS STRING)) AS i,
CASE l_orderkey % 10 WHEN 0 THEN {ANSWER} WHEN 5 THEN {ANSWER} WHEN 1 THEN concat('q x n = ', {ANSWER}) WHEN 6 THEN concat('The product is ', {ANSWER}, '.')
WHEN 2 THEN concat(substr({ANSWER}, 1, 1), ',', substr({ANSWER}, 2)) WHEN 7 THEN concat('1, 2: ', {ANSWER})
WHEN 3 THEN 'I cannot say' WHEN 8 THEN concat('It is 00', {ANSWER}, ' or maybe 7') WHEN 4 THEN NULL ELSE concat('about ', {ANSWER}, ' or 99999999999999999999999') END AS r,
{ANSWER} AS answer"""
TEMPLATES = """doc_id AS p,
CASE doc_id % 6 WHEN 0 THEN concat('Please multiply {a} by {b}. ', text) WHEN 1 THEN concat(text, ' Think step by step about {a}?')
WHEN 2 THEN concat('You are a careful assistant. Only the number. ', text, ' {b}') WHEN 3 THEN text
WHEN 4 THEN concat('1. Read {a} 2. **Reply** at once; no explanation. ', text) ELSE concat('FIRST: COMPUTE {a} x {b} NOW. ', text) END AS text"""


def responses(spark: SparkSession, directory: str) -> DataFrame:
    """Integer answers of ten kinds: right, with commas, refused, failed, hedged."""
    return table(spark, directory, "lineitem").selectExpr(*_columns(RESPONSES))


def templates(spark: SparkSession, directory: str, *others: str) -> DataFrame:
    return table(spark, directory, "documents").selectExpr(*_columns(TEMPLATES), *others)


def dense_cells(spark: SparkSession, directory: str) -> DataFrame:
    """A full matrix with five items: users by kinds of events."""
    events = table(spark, directory, "events")
    return events.selectExpr("user_id AS p", "event_type AS i", "value").groupBy("p", "i").agg({"value": "max"}).selectExpr("p", "i", "cast(`max(value)` >= 97 AS INT) AS c")


def sparse_cells(spark: SparkSession, directory: str) -> DataFrame:
    """A matrix with 24 items in which most wordings lack some: users by hours."""
    events = table(spark, directory, "events")
    return events.selectExpr("user_id AS p", "hour(ts) AS i", "value").groupBy("p", "i").agg({"value": "max"}).selectExpr("p", "i", "cast(`max(value)` >= 60 AS INT) AS c")


def _columns(select: str) -> list[str]:
    """A select list cut at its outer commas."""
    out, depth, quoted, at, cased = [], 0, False, 0, 0
    for k, ch in enumerate(select):
        if ch == "'":
            quoted = not quoted
        if not quoted:
            depth += (ch == "(") - (ch == ")")
            cased += select[k : k + 5] == "CASE "
            cased -= select[k : k + 4] == "END "
            if ch == "," and depth == 0 and cased == 0:
                out.append(select[at:k])
                at = k + 1
    return [*out, select[at:]]
