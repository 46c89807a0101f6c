"""Queries by name, with the DuckDB SQL that gives the same rows."""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations"


def query(name: str, oracle: str | None = None):
    def add(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return add


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Run SQL over the Parquet tables of sf_dir; every table has an alias."""
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({TABLES}) ", rf"\1 parquet.`{sf_dir}/\2.parquet` ", text))


def both(name: str, text: str, **dialects: str) -> None:
    """Register SQL that both engines read, but for {words} given as Spark and DuckDB forms, separated by a bar."""
    spark_text = duck_text = text
    for word, forms in dialects.items():
        ours, theirs = forms.split("||")
        spark_text, duck_text = spark_text.replace("{" + word + "}", ours), duck_text.replace("{" + word + "}", theirs)
    query(name, duck_text)(lambda spark, sf_dir: sql(spark, sf_dir, spark_text))


def with_(*parts: tuple[str, str]) -> str:
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in parts) + " "


# Citations made from the star schema, in SQL that both engines read. part: works of two authorities; lineitem: what documents (orders) cite.
WORKS = ("works", """
    SELECT p.p_partkey AS work_id, '10.' || cast(1000 + p.p_partkey % 9000 AS string) || '/w.' || cast(p.p_partkey AS string) AS doi,
           p.p_name || ' ' || p.p_type AS title, 1990 + p.p_size % 30 AS year,
           CASE WHEN p.p_partkey % 37 = 0 THEN 'unreachable' WHEN p.p_partkey % 2 = 0 THEN 'hit' ELSE 'miss' END AS crossref,
           CASE WHEN p.p_partkey % 41 = 0 THEN 'unreachable' WHEN p.p_partkey % 3 = 0 THEN 'hit' ELSE 'miss' END AS openalex
    FROM part p""")
CITES = ("cites", """
    SELECT l.l_orderkey AS doc_id, l.l_linenumber AS line, l.l_suppkey AS suppkey, l.l_shipdate AS shipped, l.l_partkey AS partkey,
           CASE (l.l_partkey + l.l_linenumber) % 20
                WHEN 0 THEN NULL WHEN 1 THEN '10.1/x' || cast(l.l_partkey AS string)
                WHEN 2 THEN '10.' || cast(1000 + l.l_partkey % 9000 AS string) || '/w.' || cast(l.l_partkey AS string) || '.v2'
                ELSE '10.' || cast(1000 + l.l_partkey % 9000 AS string) || '/w.' || cast(l.l_partkey AS string) END AS identifier,
           CASE WHEN l.l_suppkey % 15 = 0 THEN 0 ELSE l.l_partkey END AS claimed_key
    FROM lineitem l""")
# labels as verdicts: what has no label could not be reached.
OBSERVATIONS = ("observations", """
    SELECT d.source AS paper, d.lang AS category,
           CASE WHEN l.doc_id IS NULL THEN 'unreachable' WHEN l.quality = 1 AND l.toxic = 0 THEN 'verified' WHEN l.quality = 1 THEN 'mismatch'
                WHEN l.toxic = 0 THEN 'not_found' ELSE 'malformed' END AS verdict
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
# Users' events as journeys of a trial: signup starts, purchase completes, a second purchase activates, error is an incident.
JOURNEYS = ("journeys", """
    SELECT cast(e.user_id AS string) AS unit_id, cast(e.user_id % 8 AS int) * 7 AS cohort_day,
           CASE WHEN e.user_id % 3 = 0 THEN 'large' ELSE 'small' END AS segment,
           CASE WHEN e.user_id % 2 = 0 THEN 'control' ELSE 'treatment' END AS arm, 1 AS started,
           max(CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END) AS completed,
           CASE WHEN sum(CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END) > 1 THEN 1 ELSE 0 END AS activated,
           max(CASE WHEN e.event_type = 'error' THEN 1 ELSE 0 END) * max(CASE WHEN e.event_type = 'purchase' THEN 1 ELSE 0 END) AS incident,
           CASE WHEN (e.user_id % 8) * 7 + 7 > 56 THEN NULL ELSE cast(e.user_id % 5 < 2 AS int) END AS retained7,
           CASE WHEN (e.user_id % 8) * 7 + 28 > 56 THEN NULL ELSE cast(e.user_id % 7 < 2 AS int) END AS retained28
    FROM events e GROUP BY e.user_id""")
