"""Line-first quality rules: lines are judged and removed first, then documents that lose too much are rejected.

A line with words fails by

* punctuation: over a quarter of its characters besides white space (ten at least) are neither
  letters (with the signs that combine with them) nor digits, or of ten words or more three in ten end in doubled
  marks, or ten or more words have no sentence mark, and neither has any line around them, up to lines
  without words, that doesn't fail by itself: prose may be wrapped anywhere
  (a line without mark that says the same few words over and over, under a third of them different, is none);
* navigation: three or more separators stand alone between its words, a fifth of all words at least;
* boilerplate: it is a short notice of licence, rights, cookies or page furniture.

Lines without words never fail. A document is rejected if the lines that fail hold over half of its characters.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphcall.llm.shared import brought_back, giving_back, put_aside

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
VERDICT = "kept boolean, n_failed_lines long, lost_chars long, clean_text string"

SYMBOLS = b"#*$%&|<>"
MARKS = re.compile(r"[^\w\s]")
#: A run of marks is entered at its start only, and never given back.
DOUBLED = re.compile(r"(?<![!?*#$%&])[!?*#$%&]{2,}+(?=\s|$)")
SEPARATORS = {b"|", b"/", b">", b"\xc2\xbb", b"\xe2\x80\xba", b"\xe2\x80\xa2", b"\xc2\xb7"}
#: What ends a sentence or its part: the characters of Unicode's property Sentence_Terminal, and the Tibetan ones, colons, semicolons and ellipses.
SENTENCE = re.compile(
    r"[.!?…:;。！？\u037E\u0589\u061B\u061D-\u061F\u06D4\u0700-\u0702\u07F9\u0837\u0839\u083D\u083E\u0964\u0965\u0F0D-\u0F12\u104A\u104B\u1362\u1364-\u1368\u166E\u1735\u1736\u17D4\u17D5"
    r"\u1803\u1809\u1944\u1945\u1AA8-\u1AAB\u1B4E\u1B4F\u1B5A\u1B5B\u1B5E\u1B5F\u1B7D-\u1B7F\u1C3B\u1C3C\u1C7E\u1C7F\u2024\u203C\u203D\u2047-\u2049\u2CF9-\u2CFB\u2E2E\u2E3C\u2E53\u2E54\uA4FF\uA60E\uA60F\uA6F3\uA6F7"
    r"\uA876\uA877\uA8CE\uA8CF\uA92F\uA9C8\uA9C9\uAA5D-\uAA5F\uAAF0\uAAF1\uABEB\uFE12\uFE15\uFE16\uFE52\uFE54-\uFE57\uFF0E\uFF1A\uFF1B\uFF61\U00010A56\U00010A57\U00010F55-\U00010F59\U00010F86-\U00010F89"
    r"\U00011047\U00011048\U000110BE-\U000110C1\U00011141-\U00011143\U000111C5\U000111C6\U000111CD\U000111DE\U000111DF\U00011238\U00011239\U0001123B\U0001123C\U000112A9\U000113D4\U000113D5\U0001144B\U0001144C"
    r"\U000115C2\U000115C3\U000115C9-\U000115D7\U00011641\U00011642\U0001173C-\U0001173E\U00011944\U00011946\U00011A42\U00011A43\U00011A9B\U00011A9C\U00011C41\U00011C42\U00011EF7\U00011EF8\U00011F43\U00011F44"
    r"\U00016A6E\U00016A6F\U00016AF5\U00016B37\U00016B38\U00016B44\U00016D6E\U00016D6F\U00016E98\U0001BC9F\U0001DA88]"
)
BOILERPLATE = re.compile(
    r"licensed under|released under the|all rights reserved|terms of (?:use|service)|privacy policy|accept (?:all )?cookies|uses cookies|cookie policy"
    r"|click here|sign up (?:now|for)|subscribe to|skip to (?:main )?content|back to top|lorem ipsum|enable javascript",
    re.I,
)
BOILERPLATE_WORDS = 20
#: Shorter lines are not judged by their share of marks.
LEAST_SOLID = 10


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """How many words lie in windows of ``size`` words that occur twice or more in the list, first ones included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    key = at[:n]
    for k in range(1, size):
        if key.max() >= 2**62 // len(ids):
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * len(ids) + at[k : n + k]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[size : n + size] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int, int, int, bool]:
    """The columns of BASE for one whole text."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(" \t\n\x0b\x0c\r"):
            seen.add(line)
    repeat = repeated_words(words)
    return len(words), chars, symbols, dup, repeat, len(words) < 50 or 100 * repeat > 50 * len(words)


def _flaw(line: str) -> str:
    """"blank" without words, "fails" by itself, "unmarked" if it fails unless a line around it has a sentence mark, or ""."""
    raw = line.encode()
    words = raw.split()
    if not words:
        return "blank"
    solid = len("".join(line.split()))
    if solid >= LEAST_SOLID:
        marks = MARKS.findall(line)
        if 4 * len(marks) > solid and 4 * sum(unicodedata.category(c)[0] != "M" for c in marks) > solid:
            return "fails"
    if len(words) >= 10 and 10 * len(DOUBLED.findall(line)) >= 3 * len(words):
        return "fails"
    if sum(w in SEPARATORS for w in words) >= max(3, len(words) / 5):
        return "fails"
    if len(words) <= BOILERPLATE_WORDS and BOILERPLATE.search(line):
        return "fails"
    if len(words) < 10 or SENTENCE.search(line):
        return ""
    return "fails" if 3 * len(set(words)) < len(words) else "unmarked"


def line_fails(line: str) -> bool:
    """Whether a line fails that stands alone."""
    return _flaw(line) in ("fails", "unmarked")


def failing(lines: list[str]) -> list[bool]:
    """Which lines of a text fail; the lines between two lines without words are asked together for a sentence mark."""
    flaws = [_flaw(x) for x in lines]
    out = [f == "fails" for f in flaws]
    if "unmarked" in flaws:
        at = 0
        while at < len(lines):
            end = at
            while end < len(lines) and flaws[end] != "blank":
                end += 1
            if "unmarked" in flaws[at:end] and not any(flaws[k] == "" and SENTENCE.search(lines[k]) for k in range(at, end)):
                for k in range(at, end):
                    out[k] = out[k] or flaws[k] == "unmarked"
            at = end + 1
    return out


def line_verdict(text: str, max_loss: float = 0.5) -> tuple[bool, int, int, str]:
    """The columns of VERDICT for one whole text, by the line rules alone."""
    lines = text.split("\n")
    failed = failing(lines)
    lost = sum(len(x) for x, f in zip(lines, failed, strict=True) if f)
    clean = "\n".join(x for x, f in zip(lines, failed, strict=True) if not f) if lost else text
    return lost <= max_loss * len(text), sum(failed), lost, clean


def judged(docs: DataFrame, *, text_col: str = "text", max_loss: float = 0.5, with_text: bool = True) -> DataFrame:
    """``docs`` with the columns of BASE and VERDICT; works on each row by itself.

    Null texts count as empty and, like all of fewer than 50 words, fail. Columns of these names in
    ``docs`` are replaced; other columns, repeated rows and rows with null ids pass unchanged. An
    empty table gives no rows. ``with_text=False`` leaves clean_text null.
    """
    added = T.StructType.fromDDL(f"{BASE}, {VERDICT}")
    docs = docs.select(*[c for c in docs.columns if c not in added.names])
    return docs.mapInArrow(giving_back(_judge(docs.columns.index(text_col), max_loss, with_text)), T.StructType([*docs.schema, *added]))


def _judge(place: int, max_loss: float, with_text: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_failed_lines", "lost_chars", "clean_text"]
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                text = batch.column(place)[k].as_py() or ""
                base, (kept, n, lost, clean) = base_counts(text), line_verdict(text, max_loss)
                rows.append((*base, kept and not base[5], n, lost, clean if with_text else None))
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            new = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    return run


def cleaned(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that pass, without the lines that failed; columns as in ``docs``, also those named as the operator's own."""
    given, names = docs.columns, T.StructType.fromDDL(f"{BASE}, {VERDICT}").names
    docs, aside = put_aside(docs, names)
    text_col = aside.get(text_col, text_col)
    rows = judged(docs, text_col=text_col, **options).where("kept").withColumn(text_col, F.col("clean_text"))
    return brought_back(rows, aside, names).select(*given)
