"""Byte-level BPE encoding and decoding as a reduction over the monoid of token lists.

A text is encoded by halves, recursively, and halves are joined at their seam by re-encoding a
window around it that grows until the tokens outside are proven. There are two kinds of seams.

Between matches of the pattern: a match is settled by its own characters and the next ones (``LOOK`` at
most), so those of the left half that end well before the seam stay, and from a place where both the
window's and the right half's matches end, the right half's go on as they are. Halves are cut before
a space where there is one near the middle, so that windows are short.

Inside a match: two neighbouring tokens are *stable* if their bytes, encoded by themselves, give these
two tokens. A token list is the encoding of its bytes exactly if all neighbours are stable: merges are
taken lowest rank first, leftmost first, so as long as no merge has crossed a seam, the two tokens at it
evolve as they would alone, and the first merge to cross it would also happen there. So a join
re-encodes a window around the seam, and widens it on the side where the window's outer token and
the token next to it are not stable; all tokens outside are then proven.

Leaves are some hundred characters of a text, or a few bytes of a match; the encodings of short
subtrees are kept. Decoding joins the bytes of tokens up a tree as well.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters behind its end that may decide a match: a contraction's two letters, or the one that ends a run.
LOOK = 3
#: Above every rank.
NO_MERGE = 1 << 40
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
#: White space as Unicode has it; the regex library's \s has the separators U+001C to U+001F besides.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _pattern(pattern: str) -> regex.Pattern:
    r"""``pattern`` with its \s and \S spelled out."""
    pattern = pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]")
    return regex.compile(pattern.replace(r"\s", f"[{WHITE}]"))


#: Patterns in which only runs of white space, or one space before other characters, hold white space: fixed values.
WORD_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class TreeBpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, *, leaf: int = 4, text_leaf: int = 384, cached: int = 600_000, cached_matches: int = 1_000_000, longest: int = 48):
        self.ranks, self.bytes_of = ranks, {n: b for b, n in ranks.items()}
        self.pattern = _pattern(pattern)
        self.find, self.match = self.pattern.findall, self.pattern.match
        self.white_space = re.compile(f"[{WHITE}] ").search
        self.leaf, self.text_leaf, self.cached, self.cached_matches, self.longest = leaf, text_leaf, cached, cached_matches, longest
        #: Bytes of matches by whether a join or a leaf alone gave their tokens, and characters of texts likewise; for tests.
        self.joined_bytes = self.leaf_bytes = self.joined_chars = self.leaf_chars = 0
        #: Whether no match holds white space after other characters, so that words can be looked up whole.
        self.by_words = pattern in WORD_PATTERNS
        self.pairs: dict[tuple[int, int], bool] = {}
        self.subtrees: dict[bytes, list[int]] = {}
        self.matches: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def merged(self, raw: bytes) -> list[int]:
        """The encoding of ``raw`` by merges: lowest rank first, leftmost first."""
        if len(raw) > 64:
            return self._merged_long(raw)
        parts, get = [raw[k : k + 1] for k in range(len(raw))], self.ranks.get
        gains = [get(raw[k : k + 2], NO_MERGE) for k in range(len(raw) - 1)]
        while gains:
            best = min(gains)
            if best == NO_MERGE:
                break
            k = gains.index(best)
            parts[k] += parts.pop(k + 1)
            del gains[k]
            if k < len(gains):
                gains[k] = get(parts[k] + parts[k + 1], NO_MERGE)
            if k:
                gains[k - 1] = get(parts[k - 1] + parts[k], NO_MERGE)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, raw: bytes) -> list[int]:
        """The same with a heap of merges and links between parts."""
        n, get = len(raw), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at k
        heap = [(g, k, k + 2) for k in range(n - 1) if (g := get(raw[k : k + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, k, stop = heapq.heappop(heap)
            if not alive[k] or end[k] >= n or end[end[k]] != stop:
                continue
            alive[end[k]] = 0
            end[k] = stop
            if stop < n:
                before[stop] = k
                if (g := get(raw[k : end[stop]])) is not None:
                    heapq.heappush(heap, (g, k, end[stop]))
            if (j := before[k]) >= 0 and (g := get(raw[j:stop])) is not None:
                heapq.heappush(heap, (g, j, stop))
        out, k = [], 0
        while k < n:
            out.append(self.ranks[raw[k : end[k]]])
            k = end[k]
        return out

    def stable(self, a: int, b: int) -> bool:
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) >= self.cached:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merged(b"".join([self.bytes_of[t] for t in left[-i:] + right[:j]]))
            wider_left = i < len(left) and not self.stable(left[-i - 1], window[0])
            wider_right = j < len(right) and not self.stable(window[-1], right[j])
            if not wider_left and not wider_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 + wider_left), j * (1 + wider_right)

    def tree(self, raw: bytes) -> list[int]:
        """The encoding of one match's bytes."""
        if len(raw) > 8:
            half = len(raw) // 2
            return self.join(self.tree(raw[:half]), self.tree(raw[half:]))
        known = self.subtrees.get(raw)
        if known is None:
            if len(raw) <= self.leaf:
                known = self.merged(raw)
            else:
                half = len(raw) // 2
                known = self.join(self.tree(raw[:half]), self.tree(raw[half:]))
            if len(self.subtrees) >= self.cached:
                self.subtrees.clear()
            self.subtrees[raw] = known
        return known

    def _match(self, match: str) -> bytes:
        known = self.matches.get(match)
        if known is None:
            raw = match.encode()
            rank = self.ranks.get(raw)  # a whole match that is a token is that token
            if rank is None:
                if len(raw) > self.leaf:
                    self.joined_bytes += len(raw)
                else:
                    self.leaf_bytes += len(raw)
            known = array("I", self.tree(raw) if rank is None else [rank]).tobytes()
            if len(match) <= self.longest:
                if len(self.matches) >= self.cached_matches:
                    self.matches.clear()
                self.matches[match] = known
        return known

    def _leaf(self, text: str, start: int, stop: int) -> tuple[list[int], list[bytes]]:
        """Where units (one match, or some that a space sets off) of a stretch of ``text`` end, and the ids of each."""
        part = text[start:stop]
        if self.by_words and "  " not in part and "\n " not in part and not self.white_space(part):
            # No match holds white space after other characters, so every space begins one.
            first, *rest = part.split(" ")
            units, known = [first, *[" " + w for w in rest]] if first else [" " + w for w in rest], self.words
            parts = list(map(known.get, units))
            if None in parts:
                if len(known) >= self.cached:
                    known.clear()
                for k, w in enumerate(units):
                    if parts[k] is None:
                        parts[k] = b"".join(map(self._match, self.find(w)))
                        if len(w) <= self.longest:
                            known[w] = parts[k]
        else:
            units = self.find(part)
            parts = list(map(self._match, units))
        return list(itertools.accumulate(map(len, units), initial=start))[1:], parts

    def _joined(self, match: str, left: bytes, right: bytes) -> bytes:
        rank = self.ranks.get(match.encode())
        return array("I", self.join(list(memoryview(left).cast("I")), list(memoryview(right).cast("I"))) if rank is None else [rank]).tobytes()

    def _halves(self, text: str, start: int, stop: int) -> tuple[list[int], list[bytes]]:
        if stop - start <= self.text_leaf:
            return self._leaf(text, start, stop)
        half = (start + stop) // 2
        seam = text.find(" ", half, half + self.text_leaf // 4)
        if seam < 0:
            seam = half
        ends, parts = self._halves(text, start, seam)
        right_ends, right_parts = self._halves(text, seam, stop)
        cut = []
        while ends and ends[-1] > seam - LOOK:
            ends.pop()
            cut.append(parts.pop())
        at, k = ends[-1] if ends else start, 0
        # Matches from the last settled one on, until one ends where one of the right half does, or where that begins.
        while at != seam and k < len(right_ends):
            end = self.match(text, at, stop).end()
            if end - at > self.longest and len(cut) == 1 and end == right_ends[0] and len(cut[0]) > 4 < len(right_parts[0]):
                # One long match over the seam: its two ends are joined, not encoded again.
                part = self._joined(text[at:end], cut[0], right_parts[0])
            else:
                part = self._match(text[at:end])
            cut = []
            ends.append(end)
            parts.append(part)
            at = end
            if at > seam:
                k = bisect.bisect_left(right_ends, at, k)
                if k < len(right_ends) and right_ends[k] == at:
                    k += 1
                    break
        ends += right_ends[k:]
        parts += right_parts[k:]
        return ends, parts

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; null and empty give none."""
        if not text:
            return b""
        if len(text) > self.text_leaf:
            self.joined_chars += len(text)
        else:
            self.leaf_chars += len(text)
        return b"".join(self._halves(text, 0, len(text))[1])

    def decode(self, ids: bytes, run: int = 1024) -> bytes:
        """The bytes of ids, joined up the tree from runs of tokens."""
        tokens = list(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))
        level = [b"".join(tokens[k : k + run]) for k in range(0, len(tokens), run)]
        while len(level) > 1:
            level = [b"".join(level[k : k + 2]) for k in range(0, len(level), 2)]
        return level[0] if level else b""


_made: dict[tuple[str, str], TreeBpe] = {}


def encoder(path: str, pattern: str) -> TreeBpe:
    """One for each Python worker, so that its caches last over tasks."""
    if (path, pattern) not in _made:
        _made[path, pattern] = TreeBpe(load_ranks(path), pattern)
    return _made[path, pattern]


def encoded(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id and its ids (little-endian u32). Null texts count as empty.

    Null ids and repeated rows pass; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, pattern).encode
        for batch in batches:
            ids = [encode(batch.column(1)[k].as_py()) for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decoded(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """One row for each row of doc_id and ids: doc_id, and the bytes of these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = encoder(ranks_path, pattern).decode
        for batch in batches:
            raw = [decode(batch.column(1)[k].as_py() or b"") for k in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of what each document encodes to and of what these ids decode to, in one pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(ranks_path, pattern)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for k in range(batch.num_rows):
                ids = bpe.encode(batch.column(1)[k].as_py())
                rows[0].append(len(ids) // 4)
                rows[1].append(hashlib.sha256(ids).hexdigest())
                rows[2].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            new = [pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *new], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, RESULT)
