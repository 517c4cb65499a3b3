"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its content says so (at the first sentence end after 512 characters, after
4096 at the latest), so that copies have the same chunks. Chunks get identifiers: their 64-bit
hash, verified by comparing all distinct chunk texts that share it; those that differ get an
ordinal besides. A document is then its recipe, the ordered list of chunk identifiers, about 8
bytes for 600, and equal texts are found by comparing recipes; whole texts are never moved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcall.llm.shared import ascii_lower, each_copy, free_name, stored

CHUNK = r"(?s).{512,4095}?[.!?\n]|.{1,4096}"


def chunks(text: Column) -> Column:
    """The chunks of a text in order; an empty text has none."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def duplicate_decisions(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", normalise: Callable[[Column], Column] = ascii_lower, chunk_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null texts count as empty and are equal to
    these; null ids are smaller than all others. Of rows that repeat both id and text one stays; they
    are counted, and written out again in chunks however many they are. Other columns are ignored; an empty table gives no rows.
    """
    text = normalise(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))

    # Each task sends a chunk once, however many documents it read that have it.
    known = source.select(F.explode(chunks(F.col("text"))).alias("chunk")).select(chunk_hash(F.col("chunk")).cast("long").alias("hash"), "chunk").distinct()
    shared = known.groupBy("hash").agg(F.count("*").alias("texts")).where("texts > 1").select("hash")
    clashes = stored(known.join(shared, "hash", "left_semi").withColumn("ordinal", F.row_number().over(Window.partitionBy("hash").orderBy("chunk"))), "chunk-clashes")

    identifier = F.transform(chunks(F.col("text")), lambda c: F.struct(chunk_hash(c).cast("long").alias("hash"), F.lit(0).alias("ordinal")))
    rows = source.select("doc_id", F.sha2("text", 256).alias("text_sha256"), identifier.alias("recipe"))
    if not clashes.isEmpty():
        rows = _with_ordinals(source, clashes, chunk_hash)
    rows = stored(rows.groupBy("doc_id", "text_sha256", "recipe").agg(F.count("*").alias("copies")), "recipes")

    groups = stored(rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")), "recipe-groups")
    # A recipe that very many rows share is a skewed key of this join, which adaptive execution splits.
    found = rows.join(groups, "recipe").select("doc_id", "text_sha256", "copies", "keep_id", "group_size")
    found = each_copy(stored(found, "decisions"), "copies", "copy")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return found.select("doc_id", "keep_id", "group_size", stays.alias("kept"), "text_sha256")


def _with_ordinals(source: DataFrame, clashes: DataFrame, chunk_hash: Callable[[Column], Column]) -> DataFrame:
    """Recipes where some hashes stand for several chunks: those chunks are looked up by their text."""
    row = source.select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"), chunks(F.col("text")).alias("chunks"))
    row = row.select("doc_id", "text_sha256", "row", F.posexplode_outer("chunks").alias("place", "chunk"))
    row = stored(row.withColumn("hash", chunk_hash(F.col("chunk")).cast("long")), "chunk-rows")
    row = row.join(clashes.select("hash", "chunk", "ordinal"), ["hash", "chunk"], "left")
    part = F.when(F.col("place").isNotNull(), F.struct("place", "hash", F.coalesce("ordinal", F.lit(0)).alias("ordinal")))
    recipe = F.transform(F.sort_array(F.collect_list(part)), lambda p: F.struct(p["hash"].alias("hash"), p["ordinal"].alias("ordinal")))
    return row.groupBy("row", "doc_id", "text_sha256").agg(recipe.alias("recipe")).drop("row")


def without_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows that repeat id and text, one."""
    kept_id, kept_sha, own = (free_name(docs, c) for c in ("_id", "_sha", "_own"))
    kept = duplicate_decisions(docs, id_col=id_col, text_col=text_col).where("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha))
    sha = F.sha2(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 256)
    rows = docs.withColumn(own, sha)
    same = rows[id_col].cast("long").eqNullSafe(kept[kept_id]) & (rows[own] == kept[kept_sha])
    return rows.join(kept, same, "left_semi").dropDuplicates([id_col, own]).drop(own)
