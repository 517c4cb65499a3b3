"""Line deduplication with levelled sorted runs of line hashes, in DataFrame functions only.

Documents arrive in batches, in ascending order of their id. The lines that a batch brings are
anti-joined with the runs of lines seen so far; what is new belongs to the smallest document of
the batch that holds it and becomes a run of its own. When a level has ``fanout`` runs, they are
merged into one run of the next level, so a line is rewritten a logarithmic number of times and
a batch meets few runs. Runs are bucketed by line hash and sorted, so only the batch is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcall.llm.shared import ascii_lower, brought_back, new_path, partitions, put_aside, stored

BLANK = " \t\n\x0b\f\r"
#: Columns that the operator makes; columns of these names in its input are left out.
RESERVED = ("_doc", "_hash", "_lines", "_dropped", "_kept_text")


def line_hash(key: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(key, 256)), 1, 16)


class Runs:
    """Owners of lines: for each line hash the document that keeps the line, in levelled sorted runs."""

    def __init__(self, spark, fanout: int = 4):
        self.spark, self.fanout, self.buckets = spark, fanout, max(8, partitions(spark))
        self.levels: list[list[tuple[str, str]]] = []
        self.made: list[str] = []

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        path = new_path(self.spark, "line-run")
        name = "run_" + path.rpartition("-")[2]
        self.made.append(name)
        out = rows.repartition(self.buckets, "hash").sortWithinPartitions("hash").write.format("parquet")
        out.bucketBy(self.buckets, "hash").sortBy("hash").option("path", path).saveAsTable(name)
        return name, path

    def unseen(self, batch: DataFrame) -> DataFrame:
        """The rows (hash, owner) of ``batch`` whose hash is in no run; one row a hash."""
        for level in self.levels:
            for name, _ in level:
                batch = batch.join(self.spark.table(name).select("hash"), "hash", "left_anti")
        return batch

    def add(self, rows: DataFrame) -> None:
        """Adds a run of rows (hash, owner) that are in no run, and compacts full levels."""
        level, run = 0, self._write(rows)
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            old = self.levels[level]
            merged = self.spark.table(old[0][0])
            for name, _ in old[1:]:
                merged = merged.unionByName(self.spark.table(name))
            run = self._write(merged)
            self._drop(level)
            level += 1

    def _drop(self, level: int) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name, path in self.levels[level]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.levels[level] = []

    def forget(self) -> None:
        """The tables leave the catalog; their files stay until the driver ends."""
        for name in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def owners(self) -> DataFrame:
        """All runs as plain files."""
        paths = [path for level in self.levels for _, path in level]
        self.forget()
        return self.spark.read.schema("hash binary, owner long").parquet(*paths)


def line_decisions(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 10, batches: int = 4, fanout: int = 2, key: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The rows of ``docs`` with ``_lines``, ``_dropped`` (places of the lines that go) and ``_kept_text``.

    A line's key is the line without white space at its ends, with A-Z lower-cased. Keys of at
    least ``least`` code points go from all documents but the one with the smallest id that
    holds them; repeats within that document stay. Null and empty texts are one empty line. A null
    id is smaller than all others; rows that share an id are one document, and each is cleaned by itself.
    Empty tables give no rows; other columns are kept.
    """
    spark = docs.sparkSession
    docs = docs.drop(*RESERVED)
    smallest = F.lit(-(2**63)).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    doc = F.coalesce(F.col(id_col).cast("long"), smallest)
    keys = F.transform(F.split(ascii_lower(text), "\n", -1), key or (lambda line: F.btrim(line, F.lit(BLANK))))
    lines = docs.select(doc.alias("_doc"), F.xxhash64(text).alias("_hash"), F.posexplode(keys).alias("place", "key"))
    lines = lines.where(F.char_length("key") >= least).select("_doc", "_hash", "place", line_hash(F.col("key")).alias("hash"))
    bounds = docs.select(F.percentile_approx(doc, [k / batches for k in range(1, batches)], 10000).alias("b")).first()["b"] or []
    lines = stored(lines, "lines")

    runs = Runs(spark, fanout)
    edges = [None, *sorted(set(bounds)), None]
    try:
        for low, high in zip(edges, edges[1:], strict=False):
            batch = lines if low is None else lines.where(F.col("_doc") > low)
            batch = batch if high is None else batch.where(F.col("_doc") <= high)
            runs.add(runs.unseen(batch.groupBy("hash").agg(F.min("_doc").alias("owner"))))
    except BaseException:
        runs.forget()  # no table of a failed run stays in the catalog
        raise

    # A line that very many documents share is a skewed key of this join, which adaptive execution splits.
    drops = lines.join(runs.owners(), "hash").where("_doc != owner").select("_doc", "_hash", "place")
    drops = drops.groupBy("_doc", "_hash").agg(F.collect_set("place").alias("_dropped"))
    rows = docs.withColumns({"_doc": doc, "_hash": F.xxhash64(text)}).join(drops, ["_doc", "_hash"], "left")
    none = F.array().cast("array<int>")
    rows = rows.withColumns({"_lines": F.split(text, "\n", -1), "_dropped": F.coalesce("_dropped", none)})
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_dropped"))
    kept = F.array_join(F.transform(stay, lambda k: F.get("_lines", k)), "\n")
    return rows.withColumn("_kept_text", F.when(F.size("_dropped") == 0, text).otherwise(kept)).drop("_doc", "_hash")


def without_repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the text that line deduplication leaves, and all its other columns as they were."""
    given = docs.columns
    docs, aside = put_aside(docs, RESERVED)
    id_col, text_col = aside.get(id_col, id_col), aside.get(text_col, text_col)
    rows = line_decisions(docs, id_col=id_col, text_col=text_col, **options)
    return brought_back(rows.withColumn(text_col, F.col("_kept_text")), aside, RESERVED).select(*given)
