"""Merkle manifest of a table, in DataFrame functions only.

A row is a leaf, the leaves of a source in order of their ids are one tree, and the roots of these trees
in order of the sources are another. A tree is made in blocks: ``fanout ** levels`` ordered nodes are
gathered to an array of fixed size, whose levels ``transform``, ``slice`` and ``array_join`` collapse inside the
row, and the roots of the blocks are the nodes of the next round. All trees of a table go up together, and those
that have come to their root drop out. A block keeps its arrays; what its root needs on its way
up is passed down from the round above, so a proof is put together once, in the row of its leaf.

Ranks within a tree are taken by range slices (a row number within a slice behind the count of the slices before
it), so a source with most rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcall.llm.shared import ascii_lower, partitions, stored


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the value's bytes in decimal, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def collapsed(nodes: Column, fanout: int) -> Column:
    """The next level of an array of digests: one digest for every ``fanout`` consecutive ones, the last run may be shorter."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / fanout).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * fanout + 1, F.lit(fanout)), ""), 256))


def _siblings(nodes: Column, place: Column, fanout: int) -> Column:
    """(left, right): the other nodes of the run that holds ``place``, joined."""
    first = place - place % fanout
    left = F.array_join(F.slice(nodes, first + 1, place % fanout), "")
    right = F.array_join(F.slice(nodes, place + 2, fanout - 1 - place % fanout), "")
    return F.struct(left.alias("left"), right.alias("right"))


def _folded(start: Column, path: Column) -> Column:
    """The root that a node leads to along its path of siblings."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` (with a column tree) with ``place``, their rank in their tree from 0, and ``count``, the tree's nodes."""
    spark = nodes.sparkSession
    rows = nodes.withColumn("_salt", F.rand(7)).repartitionByRange(partitions(spark), "tree", *order, "_salt")
    rows = stored(rows.withColumn("_part", F.spark_partition_id()), "merkle-slices")
    sizes = rows.groupBy("tree", "_part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    sizes = sizes.select("tree", "_part", (F.sum("n").over(whole.orderBy("_part")) - F.col("n")).alias("_before"), F.sum("n").over(whole).alias("count"))
    within = F.row_number().over(Window.partitionBy("tree", "_part").orderBy(*order, "_salt"))
    return rows.withColumn("_row", within).join(sizes.hint("merge"), ["tree", "_part"]).withColumn("place", F.col("_row") - 1 + F.col("_before")).drop("_salt", "_part", "_row", "_before")


class Trees:
    """Trees over ranked nodes (tree, place, count, node and other columns), all of a table at once."""

    def __init__(self, nodes: DataFrame, fanout: int, levels: int):
        self.fanout, self.levels, self.block = fanout, levels, fanout**levels
        self.rounds: list[DataFrame] = []
        roots = None
        while True:
            own = [c for c in nodes.columns if c not in ("tree", "count")]
            blocks = nodes.withColumn("block", F.expr(f"place div {self.block}")).groupBy("tree", "block", "count")
            blocks = blocks.agg(F.sort_array(F.collect_list(F.struct("place", *[c for c in own if c != "place"]))).alias("nodes"))
            level, columns = F.transform("nodes", lambda x: x["node"]), []
            for k in range(levels):
                # A tree of one block ends as soon as one node is left; in larger ones all blocks go up as far.
                blocks = blocks.withColumn(f"level{k}", level)
                done = (F.col("count") <= self.block) & (F.size(f"level{k}") == 1)
                level = F.when(done, F.col(f"level{k}")).otherwise(collapsed(F.col(f"level{k}"), fanout))
                columns.append(f"level{k}")
            blocks = stored(blocks.select("tree", "block", "count", "nodes", *columns, F.get(level, F.lit(0)).alias("node")), "merkle-blocks")
            self.rounds.append(blocks)
            top = blocks.where(F.col("count") <= self.block).select("tree", F.col("node").alias("root"))
            roots = top if roots is None else roots.unionByName(top)
            nodes = blocks.where(F.col("count") > self.block).select("tree", F.col("block").alias("place"), F.ceil(F.col("count") / self.block).alias("count"), "node")
            if nodes.isEmpty():
                break
        self.roots = roots

    def _path(self, place: Column) -> Column:
        """Siblings of a node on its way to the root of its block, lowest level first."""
        levels, at = [], place
        for k in range(self.levels):
            goes_up = (F.col("count") > self.block) | (F.size(f"level{k}") > 1)
            levels.append(F.when(goes_up, _siblings(F.col(f"level{k}"), at, self.fanout)))
            at = F.floor(at / self.fanout).cast("int")
        return F.filter(F.array(*levels), lambda s: s.isNotNull())

    def with_paths(self, above: DataFrame) -> DataFrame:
        """Every node with its columns, ``path`` (its siblings up to the root of its tree, and on along the path of ``above``) and the other columns of ``above`` (tree, path, ...)."""
        carried = [c for c in above.columns if c not in ("tree", "path")]
        above, upper = above.withColumnRenamed("path", "upper"), None
        for k, blocks in reversed(list(enumerate(self.rounds))):
            # A tree that ends in this round is one block, so neither join meets a frequent key. Paths are long: they are merged, never broadcast.
            found = blocks.where(F.col("count") <= self.block).join(above.hint("merge"), "tree")
            if upper is not None:
                found = found.unionByName(blocks.where(F.col("count") > self.block).join(upper.hint("merge"), ["tree", "block"]))
            rows = found.select("*", F.posexplode("nodes").alias("_at", "_node"))
            rows = rows.select("tree", F.col("_node.*"), F.concat(self._path(F.col("_at")), F.col("upper")).alias("path"), *carried)
            if k:
                upper = stored(rows.select("tree", F.col("place").alias("block"), F.col("path").alias("upper"), *carried), "merkle-paths")
        return rows


def manifest(
    docs: DataFrame, *, id_col: str = "doc_id", group_col: str = "source", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = 16, levels: int = 2,
    tampered: dict[str, Column] | None = None, tamper: Column | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the digest of ``columns``, in this order; null is a value of its own, which no text equals. Leaves of a
    source ascend by id, null ids first, and those of one id by their digest; equal rows are equal leaves side by side. A null source is
    a source of its own, before all others. ``tampered`` gives columns for rows where ``tamper`` is true (null: untouched),
    and ``folded_root`` is worked out from the leaf of the columns so changed along the original siblings;
    without it, from the original leaf. Other columns are ignored, also those named as the new ones; very long texts are hashed where they
    are read and move nowhere; an empty table gives no rows.
    """
    spark = docs.sparkSession
    wrong = {c: F.when(tamper, v).otherwise(F.col(c)) for c, v in (tampered or {}).items()}
    leaf = digest(*[field(F.col(c)) for c in columns])
    other = F.when(tamper, digest(*[field(wrong.get(c, F.col(c))) for c in columns])) if tampered else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # null first, then as the bytes of UTF-8 are
    leaves = docs.select(tree.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf.alias("node"), other.alias("changed"))
    forest = Trees(ranked(leaves, ["id", "node"]), fanout, levels)
    roots = stored(forest.roots, "merkle-roots")

    sources = roots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), F.col("root").alias("node"))
    top = Trees(ranked(sources, ["source"]), fanout, levels)
    root = (top.roots.select("root").first() or [None])[0]
    none = F.array().cast("array<struct<left:string,right:string>>")
    paths = top.with_paths(spark.createDataFrame([("",)], "tree string").withColumn("path", none))
    rows = forest.with_paths(stored(paths.select(F.col("source").alias("tree"), "path", F.col("node").alias("subroot")), "merkle-sources"))

    proof = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    source = F.when(F.col("tree") != "", F.substring("tree", 2, 2**31 - 1))
    folded = _folded(F.coalesce("changed", "node"), F.col("path"))
    rows = rows.select(F.col("id").alias("doc_id"), source.alias("source"), F.col("node").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", one_in: int = 5) -> dict:
    """The tampering of the query: A-Z of the text lower-cased where ``one_in`` divides the CRC-32 of the decimal id."""
    return {"tampered": {text_col: ascii_lower(F.col(text_col))}, "tamper": F.crc32(F.col(id_col).cast("string")) % one_in == 0}
