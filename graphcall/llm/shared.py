"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcall.operators import storage
from graphcall.operators.storage import each_copy, new_path

__all__ = ["WS", "ascii_lower", "brought_back", "each_copy", "free_name", "giving_back", "new_path", "partitions", "put_aside", "stored"]

#: The white space that separates words: space, tab, newline, vertical tab, form feed, return.
WS = r"[\x20\x09-\x0D]"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage, survives lost executors."""
    return storage.cut(df, name)


def giving_back(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that hands free memory back to the system when a task ends: workers live on, and other operators run in them."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)

    return whole


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with marks behind it until no column of ``df`` is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def put_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names under others, and what each is called now; :func:`brought_back` undoes it."""
    aside = {c: free_name(docs, f"_given_{c}") for c in docs.columns if c in set(names)}
    return docs.withColumnsRenamed(aside), aside


def brought_back(rows: DataFrame, aside: dict[str, str], names: Iterable[str]) -> DataFrame:
    """Without the columns of ``names``, and with those that were put aside as they were called."""
    return rows.drop(*names).withColumnsRenamed({v: k for k, v in aside.items()})


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    ``lower`` does exactly this on ASCII; other texts are cut into runs of ASCII and of other
    characters, and only the former are lower-cased.
    """
    runs = F.regexp_extract_all(text, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]+"), F.lit(0))
    mixed = F.array_join(F.transform(runs, lambda s: F.when(F.ascii(s) < 128, F.lower(s)).otherwise(s)), "")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(mixed)
