"""Shards by extendible hashing, in DataFrame functions only.

A row's hash, the first bits of a SHA-256, decides its shard. The directory is indexed by the first
bits of the hash; a bucket is named by a prefix of these bits, and only a bucket over the byte limit
splits, on one more bit, until every bucket fits. Rows are summed once by a long prefix, the sums are
folded a few levels at a time to those of shorter prefixes, and the splits are worked out on
these sums; where a long prefix is itself too large, only its rows are looked at again, with
more bits. A row's directory entry is found by an equi-join on its prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcall.llm.shared import each_copy, stored

#: Bytes that a row counts besides its text, so that a shard of empty texts is bounded too.
ROW_BYTES = 16
#: Bits of a hash: fifteen hexadecimal digits, which a long holds without its sign.
DEEPEST = 60
#: Levels of prefixes that one fold goes up.
FOLD = 6


def sha_bits(value: Column) -> Column:
    """The first DEEPEST bits of the SHA-256 of a string."""
    return F.conv(F.substring(F.sha2(value, 256), 1, DEEPEST // 4), 16, 10).cast("long")


def _prefix(value: Column, depth: int) -> Column:
    """The first ``depth`` bits of a hash."""
    return F.shiftright(value, DEEPEST - depth) if depth else F.lit(0).cast("long")


def _folded(cells: DataFrame, start: int, depth: int) -> DataFrame:
    """Sums (depth, prefix, bytes, n) of every prefix from ``start`` to ``depth`` bits, from those of ``depth`` bits (cell, bytes, n)."""
    out = None
    while True:
        top = max(start, depth - FOLD + 1)
        nodes = cells.select(F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth"), "cell", "bytes", "n")
        nodes = nodes.select("depth", F.expr(f"shiftright(cell, {depth} - depth)").alias("prefix"), "bytes", "n")
        nodes = stored(nodes.groupBy("depth", "prefix").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "shard-nodes")
        out = nodes if out is None else out.unionByName(nodes)
        if top == start:
            return out
        cells = nodes.where(F.col("depth") == top).select(F.shiftright("prefix", 1).alias("cell"), "bytes", "n")
        cells, depth = cells.groupBy("cell").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), top - 1


def _bits(prefix: str, depth: str) -> Column:
    return F.when(F.col(depth) == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col(prefix).cast("string"), 10, 2), F.col(depth), F.lit("0")))


def assigned(rows: DataFrame, limit: int, *, bytes_col: str = "n_bytes", hash_col: str = "hash", detail: int = 6) -> DataFrame:
    """``rows`` with shard (the bits of its prefix), depth, shard_bytes and shard_rows.

    A shard's bytes are at most ``limit`` unless it is one row. ``hash_col`` must be as good as
    unique: give equal rows different hashes. Null bytes count as zero. An empty table gives no rows.
    """
    rows = rows.withColumns({"hash": F.col(hash_col).cast("long"), "_bytes": F.coalesce(F.col(bytes_col), F.lit(0)).cast("long")})
    total = rows.agg(F.sum("_bytes")).first()[0] or 0
    start, depth = 0, min(DEEPEST, max(0, math.ceil(math.log2(max(1, total / limit)))) + detail)
    done: list[DataFrame] = []
    columns = [c for c in rows.columns if c != "_bytes"]
    while True:
        cells = rows.groupBy(_prefix(F.col("hash"), depth).alias("cell")).agg(F.sum("_bytes").alias("bytes"), F.count("*").alias("n"))
        nodes = _folded(cells, start, depth)
        fits = (F.col("bytes") <= limit) | (F.col("n") == 1) | F.lit(depth >= DEEPEST)
        split = nodes.where(~fits).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"))
        leaf = nodes.where(fits).withColumn("parent", F.shiftright("prefix", 1))
        leaves = leaf.where(F.col("depth") == start).select("depth", "prefix", "bytes", "n").unionByName(
            leaf.where(F.col("depth") > start).join(split, ["depth", "parent"], "left_semi").select("depth", "prefix", "bytes", "n")
        )
        # The directory: an entry for each prefix of `depth` bits, many to a bucket that is less deep.
        entry = F.explode(F.expr(f"sequence(shiftleft(prefix, {depth} - depth), shiftleft(prefix + 1, {depth} - depth) - 1)"))
        directory = leaves.select(entry.alias("cell"), _bits("prefix", "depth").alias("shard"), F.col("depth").cast("int").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"))
        found = rows.withColumn("cell", _prefix(F.col("hash"), depth))
        done.append(found.join(directory, "cell").select(*columns, "shard", "depth", "shard_bytes", "shard_rows"))
        over = nodes.where((F.col("depth") == depth) & ~fits).select(F.col("prefix").alias("cell"))
        if over.isEmpty():
            break
        rows = stored(found.join(over, "cell", "left_semi").drop("cell"), "shard-rows")
        start, depth = depth, min(DEEPEST, depth + 8)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _content(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """SHA-256 of a row's id and text; null ids and texts are values of their own."""
    doc, text = F.coalesce(docs[id_col].cast("long").cast("string"), F.lit("null")), docs[text_col].cast("string")
    return F.sha2(F.concat(doc, F.when(text.isNull(), ":-").otherwise(":+"), F.coalesce(text, F.lit(""))), 256)


def shard_rows(docs: DataFrame, limit: int | None = None, *, least: int = 16, most: int = 64 * 2**20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, content, hash, copy and the columns of :func:`assigned`.

    Without a ``limit``, a shard holds at most ``most`` bytes, and at most one part in ``least`` of all.
    Rows that repeat id and text are numbered and hashed with their number, so that even a third
    of all rows being one and the same spreads over shards; they are written out in chunks, so no array holds all of them. Null ids and texts are values of their
    own; a null text has no bytes but ROW_BYTES; other columns are ignored.
    """
    size = (F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) + ROW_BYTES).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n_bytes"), _content(docs, id_col, text_col).alias("content"))
    rows = rows.groupBy("doc_id", "n_bytes", "content").agg(F.count("*").alias("copies"))
    rows = each_copy(stored(rows, "shard-contents"), "copies", "copy")
    rows = stored(rows.select("doc_id", "n_bytes", "content", "copy", sha_bits(F.concat("content", F.lit(":"), F.col("copy").cast("string"))).alias("hash")), "shard-keys")
    if limit is None:
        limit = min(most, -(-(rows.agg(F.sum("n_bytes")).first()[0] or 1) // least))
    return assigned(rows, limit)


def write_shards(docs: DataFrame, path: str, limit: int, *, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs`` to ``path``, a folder ``shard=<bits>`` for each shard; every row keeps its own columns.

    Rows that repeat id and text are numbered here as they are in :func:`shard_rows`: equal rows are counted first,
    and those that differ elsewhere take their numbers by slices, so that no id and text is numbered in one task.
    Columns named shard, or as the helper columns _content, _n, _slice, _before and _copy, are replaced.
    """
    docs = docs.drop("shard", "_content", "_n", "_slice", "_before", "_copy")
    own = docs.columns
    rows = docs.withColumn("_content", _content(docs, id_col, text_col)).groupBy(*own, "_content").agg(F.count("*").alias("_n"))
    rows = stored(rows.withColumn("_slice", F.pmod(F.xxhash64(*own), F.lit(64))), "shard-copies")
    sums = rows.groupBy("_content", "_slice").agg(F.sum("_n").alias("_before"))
    sums = sums.withColumn("_before", F.sum("_before").over(Window.partitionBy("_content").orderBy("_slice")) - F.col("_before"))
    first = F.sum("_n").over(Window.partitionBy("_content", "_slice").orderBy(*own)) - F.col("_n") + F.col("_before")
    rows = stored(rows.join(sums, ["_content", "_slice"]).withColumn("_before", first), "shard-numbers")
    rows = each_copy(rows, "_n", "_copy", start=F.col("_before") + 1)
    place = shard_rows(docs, limit, id_col=id_col, text_col=text_col).select(F.col("content").alias("_content"), F.col("copy").alias("_copy"), F.concat(F.lit("b"), "shard").alias("shard"))
    rows.join(place, ["_content", "_copy"]).select(*own, "shard").repartition("shard").write.partitionBy("shard").parquet(path)
