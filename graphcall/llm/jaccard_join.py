"""Documents whose sets of word n-grams have a Jaccard similarity of at least a threshold, by MinHash banding.

Documents with equal n-gram sets are one class and take part once, with the number of their
copies as weight. A class has a MinHash signature of ``bands`` bands of ``rows`` values; classes
that agree on a band meet in its bucket, and every pair that meets is verified on the full sets.

* Buckets of at most ``small`` classes give pairs; a pair is verified once, however many buckets it has.
* Classes of larger buckets are joined to clusters (connected components over large buckets), and all
  pairs of a cluster whose sizes allow a link are verified in blocks, which follow the sets' sizes: a task
  holds two blocks of some hundred sets, counts links by a product of 0/1 matrices and keeps where they lead, so no pair
  of a large cluster becomes a row.

Both count links, and the links' connected components are the groups. N-grams are compared as 64-bit hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcall.llm.shared import free_name, giving_back, stored

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Longer words (in bytes) are not kept in caches.
LONGEST_WORD = 128
#: Sets in a block, and their bytes, of which shares add up to one or about (a single set may be larger).
BLOCK_SETS, BLOCK_BYTES = 1024, 8 * 2**20


def band_counts(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """Bands and rows: the most selective rows whose bands reach ``recall`` at the threshold within ``most`` values.

    Bands of one row are taken, as many as it needs, where no choice keeps within ``most``.
    """
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold in (0, 1] and recall in (0, 1)")
    best = (1, 32)
    if threshold == 1:
        return best
    for rows in range(1, 33):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if rows == 1:
            best = (bands, 1)
        if bands * rows <= most:
            best = (bands, rows)
    return best


class Shingler:
    """N-gram sets of whole texts as sorted arrays of 64-bit hashes, and their MinHash bands.

    Words are what white space separates, lower-cased. A text of fewer words than an n-gram has one
    n-gram of all its words; a text without words has none.
    """

    def __init__(self, size: int, bands: int, rows: int, cached: int = 200_000):
        self.size, self.bands, self.rows, self.cached = size, bands, rows, cached
        rng = np.random.default_rng(20240229)
        self.a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.words: dict[bytes, int] = {}

    def shingles(self, text: str | None) -> np.ndarray:
        words, known = (text or "").lower().encode().split(), self.words
        if not words:
            return np.zeros(0, np.uint64)
        try:
            at = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) >= self.cached:
                known.clear()
            for w in words:
                if len(w) <= LONGEST_WORD and w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            at = np.fromiter((known[w] if w in known else xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
        size = min(self.size, len(at))
        out = at[: len(at) - size + 1].copy()
        for k in range(1, size):
            out *= MIX
            out ^= out >> np.uint64(29)
            out += at[k : len(at) - size + 1 + k]
        out ^= out >> np.uint64(32)
        out *= MIX
        out ^= out >> np.uint64(29)
        return np.unique(out)

    def band_hashes(self, shingles: np.ndarray) -> np.ndarray:
        if not len(shingles):
            return np.zeros(0, np.int64)
        least = np.full(len(self.a), 2**64 - 1, np.uint64)
        for k in range(0, len(shingles), 1024):
            part = shingles[k : k + 1024]
            np.minimum(least, (self.a[:, None] * part[None, :] + self.b[:, None]).min(axis=1), out=least)
        value = least.reshape(self.bands, self.rows)
        out = np.arange(1, self.bands + 1, dtype=np.uint64) * MIX
        for k in range(self.rows):
            out = (out ^ value[:, k]) * MIX
            out ^= out >> np.uint64(31)
        return out.view(np.int64)


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


_made: dict[tuple[int, int, int], Shingler] = {}


def _shingler(*args: int) -> Shingler:
    if args not in _made:
        _made[args] = Shingler(*args)
    return _made[args]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, label) for each node, the label its smallest node.

    Labels spread over edges and then jump to their own label, so paths shorten by half each round.
    Every round is written to the shared folder; only a count of changes comes to the driver.
    """
    edges = edges.select("a", "b").where("a <> b")
    both = stored(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    changed = not labels.isEmpty()
    while changed:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        spread = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("far"))
        new = spread.join(jump, "mid").select("node", "old", F.least("mid", "far").alias("label"))
        new = stored(new, "labels")
        changed = not new.where("old <> label").isEmpty()
        labels = new.select("node", "label")
    return labels


def jaccard_links(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999, small: int = 16,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id, n_links, copy_id, n_copies.

    ``n_links`` counts the other documents that are at least ``threshold`` similar, those with the same
    set included; ``class_id`` is the smallest id of the group that links connect, ``copy_id`` of the documents
    with the same set. ``recall`` is the chance that a pair just at the threshold meets in a band.
    Null texts count as empty; documents without words have the same empty set and no other links.
    Rows with null or repeated ids are documents of their own; other columns are ignored; an empty table gives no rows.
    """
    signed, found = _grouped(docs, id_col, text_col, size, threshold, recall, small)
    least = found.groupBy("label").agg(F.min("copy_id").alias("class_id"))
    found = found.join(least, "label").select("key", "class_id", "copy_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return signed.select("doc_id", "key").join(found, "key").select("doc_id", "class_id", "n_links", "copy_id", F.col("copies").alias("n_copies"))


def _digest(doc: Column, text: Column) -> Column:
    """SHA-256 of an id and a text, not null; null ids and texts are values of their own."""
    doc = F.coalesce(doc.cast("long").cast("string"), F.lit("null"))
    return F.unhex(F.sha2(F.concat(doc, F.when(text.isNull(), ":-").otherwise(":+"), F.coalesce(text.cast("string"), F.lit(""))), 256))


def _grouped(
    docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float, recall: float, small: int, digests: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``docs`` as (doc_id, key, and with ``digests`` the digest of id and text), and each set as (key, copy_id, copies, label of its group, links)."""
    bands, rows = band_counts(threshold, recall)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = own.select("doc_id", *([_digest(F.col("doc_id"), F.col("text")).alias("digest")] if digests else []), "text")
    signed = stored(named.mapInArrow(giving_back(_sign(size, bands, rows)), f"doc_id long, {'digest binary, ' if digests else ''}key binary, n int, bands array<long>"), "signatures")
    classes = signed.groupBy("key").agg(F.min("doc_id").alias("copy_id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    classes = stored(classes, "classes")

    member = classes.where("n > 0").select("key", "n", F.posexplode("bands").alias("band", "hash"))
    buckets = stored(member.groupBy("band", "hash").agg(F.count("*").alias("m")).where("m > 1"), "buckets")
    met = stored(member.join(buckets, ["band", "hash"]), "met")

    large = met.where(F.col("m") > small).select("key", F.xxhash64("band", "hash").alias("bucket"))
    heads = stored(large.groupBy("bucket").agg(F.min("key").alias("head")), "heads")
    clusters = components(large.join(heads, "bucket").select(F.col("key").alias("a"), F.col("head").alias("b")))

    lists = met.where(F.col("m") <= small).groupBy("band", "hash").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("keys"))
    first = lists.select(F.posexplode("keys").alias("k", "x"), "keys")
    pairs = first.select("x", F.explode(F.slice("keys", F.col("k") + 2, small)).alias("y"))
    pairs = pairs.where(F.least("x.n", "y.n") >= threshold * F.greatest("x.n", "y.n")).select(F.col("x.key").alias("a"), F.col("y.key").alias("b")).distinct()
    ca, cb = (clusters.select(F.col("node").alias(c), F.col("label").alias(f"{c}_cluster")) for c in "ab")
    pairs = pairs.join(ca, "a", "left").join(cb, "b", "left").where(~F.coalesce(F.col("a_cluster") == F.col("b_cluster"), F.lit(False))).select("a", "b")
    pairs = stored(pairs, "pairs")

    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).unionByName(clusters.select(F.col("node").alias("key"))).distinct()
    wanted = classes.select("key", "copies", "copy_id").join(wanted, "key", "left_semi")
    ids = wanted.select(F.coalesce("copy_id", F.lit(-(2**63))).alias("_id")).distinct()
    texts = own.withColumn("_id", F.coalesce("doc_id", F.lit(-(2**63)))).join(ids, "_id", "left_semi").select("text")
    sets = texts.mapInArrow(giving_back(_sets(size, bands, rows)), "key binary, shingles binary").dropDuplicates(["key"])
    sets = stored(sets.join(wanted.select("key", "copies"), "key"), "sets")

    sa, sb = (sets.select(F.col("key").alias(c), F.col("copies").alias(f"{c}_copies"), F.col("shingles").alias(f"{c}_set")) for c in "ab")
    close = pairs.join(sa, "a").join(sb, "b").select("a", "b", "a_copies", "b_copies", "a_set", "b_set")
    close = stored(close.mapInArrow(_verify(threshold), "a binary, b binary, a_copies long, b_copies long"), "links")
    dense = stored(_cluster_links(sets, clusters, threshold), "cluster-links")

    counts = close.select(F.col("a").alias("key"), F.col("b_copies").alias("links")).unionByName(close.select(F.col("b").alias("key"), F.col("a_copies").alias("links")))
    counts = counts.unionByName(dense.select("key", "links")).groupBy("key").agg(F.sum("links").alias("links"))
    groups = components(close.select("a", "b").unionByName(dense.select(F.col("key").alias("a"), F.col("root").alias("b"))))

    found = classes.select("key", "copy_id", "copies").join(groups.select(F.col("node").alias("key"), "label"), "key", "left").join(counts, "key", "left")
    return signed, stored(found.withColumn("label", F.coalesce("label", "key")), "found")


def _sign(size: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _shingler(size, bands, rows)
        for batch in batches:
            keys, counts, values = [], [], []
            for k in range(batch.num_rows):
                found = s.shingles(batch.column(batch.num_columns - 1)[k].as_py())
                keys.append(set_key(found))
                counts.append(len(found))
                values.append(s.band_hashes(found))
            new = [pa.array(keys, pa.binary()), pa.array(counts, pa.int32()), pa.array(values, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*batch.schema.names[:-1], "key", "n", "bands"])

    return run


def _sets(size: int, bands: int, rows: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = _shingler(size, bands, rows)
        for batch in batches:
            found = [s.shingles(batch.column(0)[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in found], pa.binary()), pa.array([x.tobytes() for x in found], pa.binary())], ["key", "shingles"])

    return run


def _verify(threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[k].as_buffer(), np.uint64) for c in (4, 5))
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(shared >= threshold * (len(both) - shared) - 1e-9)
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "a_copies", "b_copies"]).filter(pa.array(keep, pa.bool_()))

    return run


def _cluster_links(sets: DataFrame, clusters: DataFrame, threshold: float) -> DataFrame:
    """For each block pair and set: key, links (copies of the sets linked to it there) and a root that its links lead to."""
    # Where each set belongs is settled on narrow rows, of which a large cluster's are split by
    # adaptive execution; the sets themselves are then dealt by their own keys. Blocks follow the sets' sizes,
    # so that pairs of blocks whose sizes rule out every link are left out. The window sees one row for
    # each size that a cluster has.
    place = clusters.select(F.col("node").alias("key"), F.col("label").alias("cluster"))
    place = stored(place.join(sets.select("key", F.octet_length("shingles").alias("bytes")), "key"), "cluster-sets")
    share = F.count("*") / BLOCK_SETS + F.sum("bytes") / BLOCK_BYTES
    sizes = place.groupBy("cluster", "bytes").agg(share.alias("share"))
    sizes = stored(sizes.withColumn("before", F.sum("share").over(Window.partitionBy("cluster").orderBy("bytes")) - F.col("share")), "cluster-sizes")
    spread = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) / (1 << 20)
    place = place.join(sizes, ["cluster", "bytes"]).select("key", "cluster", "bytes", F.floor(F.col("before") + F.col("share") * spread).alias("block"))
    place = stored(place, "cluster-blocks")
    shape = stored(place.groupBy("cluster", "block").agg(F.min("bytes").alias("least"), F.max("bytes").alias("most")), "cluster-shapes")
    i, j = (shape.select("cluster", F.col("block").alias(c), F.col("least").alias(f"{c}_least"), F.col("most").alias(f"{c}_most")) for c in "ij")
    met = i.join(j, "cluster").where((F.col("i") <= F.col("j")) & (F.col("i_most") >= threshold * F.col("j_least") - 1e-6)).select("cluster", "i", "j")
    met = stored(met.select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block")), "block-pairs")
    own = sets.join(place.select("key", "cluster", "block"), "key").join(met, ["cluster", "block"]).select("cluster", "i", "j", "block", "key", "copies", "shingles")
    return own.groupBy("cluster", "i", "j").applyInPandas(_block(threshold), "key binary, links long, root binary")


#: Columns of the 0/1 matrices that sets of a block pair are multiplied in.
COLUMNS = 4096


def shared_counts(at: np.ndarray, owner: np.ndarray, left: np.ndarray, other: np.ndarray, count: int) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``other``; ``at`` and ``owner`` are values and the sets (of ``count``) that hold them, set by set.

    Values that one set alone holds are left out. Near-equal sets have few others, and are multiplied as matrices of a bounded
    number of columns; where very many are held by few sets each, every left set is marked and the others are summed under the mark.
    """
    sets = np.bincount(at)
    keep = sets[at] > 1
    at, owner = (np.cumsum(sets > 1) - 1)[at[keep]], owner[keep]
    values = int((sets > 1).sum())
    shared = np.zeros((len(left), len(other)), np.float32)
    if values * len(other) <= 16 * max(1, len(at)):
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(0, values + COLUMNS, COLUMNS))
        for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
            cells = np.zeros((count, min(COLUMNS, values - k * COLUMNS)), np.float32)
            cells[owner[order[x:y]], at[order[x:y]] - k * COLUMNS] = 1
            shared += cells[left] @ cells[other].T
        return shared
    sizes = np.bincount(owner, minlength=count)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.concatenate([at[starts[k] : starts[k + 1]] for k in other])
    some = np.flatnonzero(sizes[other])
    begins = np.concatenate([[0], np.cumsum(sizes[other])])[some]
    mark = np.zeros(values, np.int32)
    for row, k in enumerate(left):
        own = at[starts[k] : starts[k + 1]]
        mark[own] = 1
        shared[row, some] = np.add.reduceat(mark[flat], begins)
        mark[own] = 0
    return shared


def _block(threshold: float) -> Callable:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(size=rows["shingles"].str.len()).sort_values(["size", "key"]).reset_index(drop=True)
        one = rows["i"].iloc[0] == rows["j"].iloc[0]
        # The sets that left ones are held against: all if the blocks are one, else those of the right block.
        in_left = (rows["block"] == rows["i"]).to_numpy()
        left = np.flatnonzero(in_left)
        other = left if one else np.flatnonzero(~in_left)
        sizes, copies = rows["size"].to_numpy() // 8, rows["copies"].to_numpy()
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        if len(left) and len(other):
            at = np.unique(np.concatenate([np.frombuffer(x, np.uint64) for x in rows["shingles"]]), return_inverse=True)[1]
            shared = shared_counts(at, np.repeat(np.arange(len(rows)), sizes), left, other, len(rows))
            near = shared >= threshold * (sizes[left][:, None] + sizes[other][None, :] - shared) - 1e-9
            if one:
                np.fill_diagonal(near, False)
            links[left] += near @ copies[other]
            if not one:
                links[other] += near.T @ copies[left]
            # The least set that links lead to, over and over until nothing changes.
            while True:
                before = root.copy()
                root[left] = np.minimum(root[left], np.where(near, root[other][None, :], len(rows)).min(axis=1))
                root[other] = np.minimum(root[other], np.where(near, root[left][:, None], len(rows)).min(axis=0))
                if (root == before).all():
                    break
        return pd.DataFrame({"key": rows["key"], "links": links, "root": rows["key"].iloc[root].to_numpy()})

    return run


def one_of_each_group(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999, small: int = 16,
) -> DataFrame:
    """``docs`` with one row of each group, and all columns as they were: the smallest id, null ids last.

    Groups are of rows, not of ids: rows that share an id, or have none, stay as often as they are in
    different groups. Of a group's rows with its smallest id, the one of the least set and text
    stays; rows that repeat id and text are one.
    """
    signed, found = _grouped(docs, id_col, text_col, size, threshold, recall, small, digests=True)
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "digest")
    # The least row of each set comes first, so that a group's label meets only one row a set.
    stays = signed.groupBy("key").agg(F.min(row).alias("row")).join(found.select("key", "label"), "key").groupBy("label").agg(F.min("row").alias("row"))
    mark = free_name(docs, "_row")
    stays = stored(stays.select(F.col("row.digest").alias(mark)), "stays")
    # Rows that repeat are combined before their exchange, and the join needs no other one: texts are dealt once.
    rows = docs.withColumn(mark, _digest(docs[id_col], docs[text_col])).dropDuplicates([mark])
    return rows.join(stays, mark, "left_semi").select(*docs.columns)
