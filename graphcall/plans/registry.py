"""Queries over domain views of the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: The domain tables, in SQL that Spark and DuckDB both read. Sources: which table each comes from.
VIEWS = {
    # Reads: a line is a read, an order a fragment; positions lie on five contigs.
    "reads": """
SELECT l_suppkey % 4 AS sample_id, l_orderkey AS fragment_id, l_linenumber % 2 = 1 AS is_first_mate, 'chr' || CAST(l_suppkey % 5 + 1 AS STRING) AS chrom,
  l_partkey * 3 AS pos, CAST(l_quantity AS BIGINT) + 50 AS len, 'chr' || CAST(l_orderkey % 5 + 1 AS STRING) AS mate_chrom, (l_partkey * 7 + l_orderkey) % 6000 AS mate_pos,
  l_suppkey % 61 AS mapq, l_linestatus = 'F' AS is_reverse, (l_partkey + l_suppkey) % 7 = 0 AS is_secondary, l_partkey % 9 > 0 AS is_unique, l_linenumber AS line, l_extendedprice AS tie
FROM lineitem""",
    # Observations: which node or edge of a site's graph a read supports; alleles are skewed by site.
    "observations": """
SELECT l_suppkey % 10 AS sample_id, l_partkey % 50 AS site, l_linenumber % 2 AS bp, l_orderkey AS fragment_id, l_linestatus = 'F' AS is_reverse,
  CASE WHEN (l_partkey * 7 + l_suppkey) % 10 < (l_partkey % 50) % 11 THEN 'REF_RF' WHEN l_returnflag = 'N' AND l_partkey % 3 = 0 THEN 'LF_INS' ELSE 'LF_ALT' END AS element,
  l_partkey AS pos, CAST(l_quantity AS BIGINT) AS qual
FROM lineitem""",
    "samples": """
SELECT s_suppkey AS sample_id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' ELSE 'Unknown' END AS sex,
  CAST(100 + 50 * (s_suppkey % 2) AS BIGINT) AS read_length, CAST(10 + s_suppkey % 40 AS DOUBLE) AS depth, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey % 7 + 1 AS DOUBLE) END AS depth_sd,
  CASE WHEN s_suppkey % 4 < 2 THEN CAST(s_suppkey % 30 + 1 AS DOUBLE) END AS depth_variance
FROM supplier""",
    # Calls: allele counts of sample, site and breakpoint.
    "counts": """
SELECT l_suppkey % 10 AS sample_id, l_partkey % 50 AS site, l_linenumber % 2 AS bp,
  SUM(CASE WHEN (l_partkey * 7 + l_suppkey) % 10 < (l_partkey % 50 + 3 * (l_linenumber % 2) * (l_partkey % 2)) % 11 THEN 1 ELSE 0 END) AS n_ref, SUM(CASE WHEN (l_partkey * 7 + l_suppkey) % 10 < (l_partkey % 50 + 3 * (l_linenumber % 2) * (l_partkey % 2)) % 11 THEN 0 ELSE 1 END) AS n_alt
FROM lineitem GROUP BY 1, 2, 3""",
    "genotypes": """
SELECT c_nationkey AS site, o_orderkey AS sample_id, CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS a, CASE WHEN (o_orderkey + o_custkey) % 5 = 0 THEN 1 ELSE 0 END AS b, o_orderkey % 19 = 0 AS missing
FROM orders JOIN customer ON o_custkey = c_custkey""",
    # Intervals on a number line, several thousand to a contig.
    "intervals": """
SELECT o_orderkey AS id, o_custkey % 20 AS chrom, (o_orderkey * 37) % 20000 AS start, (o_orderkey * 37) % 20000 + o_custkey % 30 AS stop, CAST(floor(o_totalprice) AS BIGINT) AS weight
FROM orders""",
    "regions": "SELECT n_nationkey AS region_id, 'chr' || CAST(n_nationkey % 5 + 1 AS STRING) AS chrom, n_nationkey * 200 AS start, n_nationkey * 200 + 300 AS stop FROM nation",
    # Bases from digits of multiples of the key: letters ACGT, and an N for nine.
    "bases": """
SELECT p_partkey AS id, p_name AS name, 'N' || translate(CAST(p_partkey * 7919 + 104729 AS STRING) || CAST((p_partkey * 15485863) % 99999989 AS STRING) || CAST((p_partkey * 32452843) % 86028121 AS STRING), '0123456789', 'ACGTACGTAN') AS seq FROM part""",
    "edges": "SELECT DISTINCT n_regionkey AS graph_id, n_nationkey AS a, (n_nationkey + n_regionkey * 3 + 5) % 30 AS b, CASE WHEN n_nationkey % 2 = 0 THEN 'REF' ELSE 'ALT' END AS label FROM nation",
    # Graphs without cycles: thirty of twelve steps, every fourth of which forks.
    "chain": """
SELECT DISTINCT o_custkey % 30 AS graph_id, (o_orderkey * 7) % 12 AS a, (o_orderkey * 7) % 12 + 1 + CASE WHEN (o_orderkey * 7) % 4 = 0 THEN CAST(floor(o_custkey / 30) AS BIGINT) % 2 ELSE 0 END AS b FROM orders""",
    "variants": """
SELECT p_partkey AS id, p_partkey % 6 AS chrom, (p_partkey * 53) % 5000 AS pos, substring('ACGTACGTACGT', CAST(1 + p_partkey % 5 AS INT), CAST(1 + p_size % 6 AS INT)) AS ref,
  substring('ACTTACGAACGT', CAST(1 + p_partkey % 5 AS INT), CAST(1 + p_size % 4 AS INT)) AS alt, p_size AS size FROM part""",
}


class Views:
    """The driver's tables at ``sf_dir``, and the domain views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """``text`` in Spark's SQL, over tables named in it."""
        used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", text)]
        text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", r"\1 {\2}", text)
        return self.spark.sql(text, **{t: self.table(t) for t in used})

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name].strip())
        raise AttributeError(name)


_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of Views; ``sql`` may name domain views."""

    def register(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        key = name or f.__name__
        _queries[key] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _sql[key] = with_views(sql)
        return f

    return register


def with_views(sql: str) -> str:
    """``sql`` with the domain views that it names as common table expressions, for DuckDB."""
    words = set("".join(c if c.isalnum() or c == "_" else " " for c in sql).split())
    ctes = []
    for v, text in VIEWS.items():
        if v in words:
            ctes.append(f"{v} AS ({text.strip()})")
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE") :]
    if body.upper().startswith("WITH"):
        return "WITH " + ", ".join(ctes) + ", " + body[len("WITH") :]
    return "WITH " + ", ".join(ctes) + " " + body


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
