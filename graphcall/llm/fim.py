"""Fill-in-middle over lines, cut by succinct rank and select.

The bytes of many texts lie one behind the other in one buffer. A packed bitvector marks each byte that
ends a line (a newline, or a text's last byte), another each byte that starts a code point. A directory
holds the number of ones before each block of 64 bits, so rank is one look-up and a popcount, and
select is a search in the directory and one within a block. The ones of a text give its number of
lines, select on two ranks gives the bytes where its prefix and middle end, and rank of code points
there gives their lengths. Texts are only sliced by bytes, never split into lines.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of text that share bitvectors (a single text may be longer).
BUFFER = 4 * 2**20
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class BitVector:
    """A packed bitvector with rank and select, both over arrays of arguments."""

    def __init__(self, bits: np.ndarray):
        self.size = len(bits)
        packed = np.zeros((self.size // 64 + 1) * 8, np.uint8)
        found = np.packbits(bits, bitorder="little")
        packed[: len(found)] = found
        self.blocks = packed.view(np.uint64)
        self.before = np.zeros(len(self.blocks) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.blocks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones in front of each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """The place of each one by its number, from 0."""
        block = np.searchsorted(self.before, nth, side="right") - 1
        left = nth - self.before[block]
        bits = np.unpackbits(self.blocks[block].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        return block * 64 + (np.cumsum(bits, axis=1, dtype=np.int64) > left[:, None]).argmax(axis=1)


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a document; a null id draws as the word null."""
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def _transform(docs: list[int | None], texts: list[bytes], seed: int, rate: int, spm_rate: int) -> list[tuple]:
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    joined = b"".join(texts)
    buffer = np.frombuffer(joined, np.uint8)
    ends = buffer == 10
    ends[starts[1:][starts[1:] > starts[:-1]] - 1] = True
    line, point = BitVector(ends), BitVector((buffer & 0xC0) != 0x80)
    first = line.rank(starts)
    n = np.diff(first)
    h = np.array([draws(d, seed) for d in docs], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    at = np.repeat(starts[:-1], 2).reshape(-1, 2)
    some = cuts > 0
    at[some] = line.select((first[:-1, None] + cuts - 1)[some]) + 1
    before = point.rank(np.column_stack([starts[:-1], at]).ravel()).reshape(-1, 3)
    chars = np.diff(before, axis=1)
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    out = []
    for k, doc in enumerate(docs):
        text, base = texts[k], int(starts[k])
        if not text or p in text or s in text or m in text or h[k, 2] % 100 >= rate:
            out.append((doc, int(n[k]), "plain", None, None, text))
            continue
        a, b = int(at[k, 0]) - base, int(at[k, 1]) - base
        spm = h[k, 3] % 100 < spm_rate
        parts = (s, text[b:], p, text[:a], m, text[a:b]) if spm else (p, text[:a], s, text[b:], m, text[a:b])
        out.append((doc, int(n[k]), "spm" if spm else "psm", int(chars[k, 0]), int(chars[k, 1]), b"".join(parts)))
    return out


def fill_in_middle(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50, buffer: int = BUFFER,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n (lines), form, prefix_chars, middle_chars, output.

    ``rate`` of a hundred documents are cut at two lines, ``spm_rate`` of a hundred of these with the suffix first; the
    numbers that decide it follow from ``seed`` and the id alone, so rows that share an id draw alike. Null and
    empty texts, and those that hold a mark, are plain: the text itself, without lengths. Rows are taken one by one, so
    repeats and ties need no rule; a null id draws as the word null. Other columns are ignored, also those named as
    the new ones; an empty table gives no rows. A very long text takes several times its bytes of a worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

        def batch_of(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            columns = list(zip(*_transform(ids, texts, seed, rate, spm_rate), strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=False)), pa.array(columns[5], pa.binary()).cast(pa.string())], names)

        for batch in batches:
            ids: list[int | None] = []
            texts: list[bytes] = []
            size = 0
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(doc.as_py())
                texts.append(text.as_py() or b"")
                size += len(texts[-1])
                if size >= buffer:
                    yield batch_of(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield batch_of(ids, texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, COLUMNS)


def restored(form: Column, output: Column) -> Column:
    """The text that :func:`fill_in_middle` was given (null as empty), from a form and its output alone.

    A mark stands nowhere in the text, and none can arise across a seam, so the first of each is the one that was set.
    """
    size, tail = F.char_length(output), F.substring(output, F.lit(len(PREFIX) + 1), F.char_length(output))

    def parts(mark: str) -> tuple[Column, Column, Column]:
        first = F.substring_index(tail, mark, 1)
        rest = F.substring(tail, F.char_length(first) + len(mark) + 1, size)
        second = F.substring_index(rest, MIDDLE, 1)
        return first, second, F.substring(rest, F.char_length(second) + len(MIDDLE) + 1, size)

    prefix, suffix, middle = parts(SUFFIX)
    late_suffix, late_prefix, late_middle = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(late_prefix, late_middle, late_suffix)).otherwise(output)
