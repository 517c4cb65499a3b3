"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphcall.plans import detail_queries, genotype_queries, graph_queries, kmer_queries, read_queries, record_queries, rewrite_queries, stat_queries  # noqa: F401  registers
from graphcall.plans.registry import oracle_sql, queries  # noqa: F401


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads to fragments to counts to genotypes: one row for each site and sample."""
    return queries()["combined_genotype"](spark, sf_dir)
