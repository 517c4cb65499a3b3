"""Personal data: fixed patterns, and a linear-chain conditional random field (CRF) for forms that these miss.

The CRF labels words (B- and I- of each kind, O) from features of their shape and of their
neighbours' shapes. It is trained on the driver from a small labelled table of a fixed number of
rows, by gradient ascent on the likelihood with forward-backward sums; its weights are a few
thousand numbers. Tasks decode with Viterbi in numpy batches. Spans it finds pass the checks of their
kind (digits, Luhn, parts of an address) and are added unless they touch a span of the patterns.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import random
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphcall.llm.shared import brought_back, giving_back, put_aside

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Rows of the labelled table that the CRF is trained on.
LABELLED_ROWS = 500

#: Fixed patterns of the contract; an equal form of the first two that can't take quadratic time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def ip_ok(text: str) -> bool:
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in text.split(".")))


def card_ok(text: str) -> bool:
    d = digits_of(text)
    return 12 <= len(d) <= 19 and luhn(d)


def phone_ok(text: str) -> bool:
    return 9 <= len(digits_of(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches that don't overlap: the longest local part before each @ with a domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, in order."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if ip_ok(m.group())]
        found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 12 and card_ok(m.group())]
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if phone_ok(m.group())]
    return sorted(found)


# The labelled table.


def labelled_table(rows: int = LABELLED_ROWS, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """(words, labels) rows: prose with personal data in many forms, and with numbers that are none."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def prose() -> list[str]:
        out = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice([word(), word(), word(), "at", "dot", "call", "the", "on"])
            w = rng.choice([w, w, w, w.capitalize(), w.upper()])
            out.append(w + rng.choice(["", "", "", "", ".", ",", "!!", "***", "%%%", "&&&", "###", "$$$"]))
        return out

    def card() -> str:
        d = rng.choice("3456") + number(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    def spam() -> tuple[str, list[str]]:
        user, host, top = word() + rng.choice(["", number(2), "." + word()]), word(), rng.choice(["com", "org", "net", "de"])
        c, p = card(), [number(3), number(3), number(4)]
        ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        return rng.choice([
            ("email", [f"{user}@{host}.{top}"]), ("email", [user, "at", host, "dot", top]), ("email", [user, "[at]", host, "[dot]", top]), ("email", [user, "(at)", f"{host}.{top}"]),
            ("ip", [ip]), ("ip", [ip + ":" + number(4)]), ("ip", [f"[{ip}]"]),
            ("card", [c]), ("card", [c[:4], c[4:8], c[8:12], c[12:]]), ("card", ["-".join((c[:4], c[4:8], c[8:12], c[12:]))]), ("card", [".".join((c[:4], c[4:8], c[8:12], c[12:]))]),
            ("phone", [f"+1 ({p[0]})".split()[0], f"({p[0]})", f"{p[1]}-{p[2]}"]), ("phone", [f"({p[0]})", f"{p[1]}-{p[2]}"]), ("phone", ["-".join(p)]), ("phone", [".".join(p)]), ("phone", [p[0], p[1], p[2]]), ("phone", ["/".join(p)]),
        ])

    def harmless() -> list[str]:
        bad = card()
        bad = bad[:-1] + str((int(bad[-1]) + rng.randint(1, 9)) % 10)
        return rng.choice([
            [str(rng.randint(1900, 2030))], [number(1) + "." + number(2) + "%"], ["v1." + number(1) + "." + number(1)], [number(2) + ":" + number(2)], ["page", number(2)], ["$" + number(3)],
            [f"{number(4)}-{number(2)}-{number(2)}"], [number(3), "000"], [number(8)], [bad], [str(rng.randint(300, 999)) + ".300.1." + number(2)], ["(" + number(2) + ")"], [number(2), number(2), number(2)], ["|"], ["|", word(), "|"],
            [word(), "at", word()], ["@" + word()], [word() + "_" + number(4)], ["sk-" + word() + number(6)],
        ])

    out = []
    for _ in range(rows):
        words, labels = prose(), []
        labels = ["O"] * len(words)
        for _ in range(rng.randint(1, 2)):
            if rng.random() < 0.6:
                kind, part = spam()
                words += part
                labels += [f"B-{kind}", *[f"I-{kind}"] * (len(part) - 1)]
            else:
                part = harmless()
                words += part
                labels += ["O"] * len(part)
            more = prose()
            words += more
            labels += ["O"] * len(more)
        out.append((words, labels))
    return out


# The model.

_TRIM = "\"'.,;:!?<>"
#: Longer words are not kept in caches.
LONGEST_WORD = 128
#: Where a word stands to the one that is labelled.
PLACES = ("0:", "-1:", "+1:")
#: Words that have a feature of their own.
LEXICON = frozenset("at dot [at] [dot] (at) (dot)".split())
_LETTERS = re.compile(r"[^\W\d_]+")


def word_class(word: str) -> tuple[str, ...]:
    """The features of a word by itself. All words of letters but those of the lexicon have the same."""
    core = word.strip(_TRIM)
    low = core.lower()
    if low in LEXICON:
        return ("word=" + low,)
    digits = digits_of(core)
    if not digits and "@" not in core:
        return ("letters",) if _LETTERS.fullmatch(core) else ("marks",)
    shape = re.sub(r"([^\W\d_])+", "a", re.sub(r"[0-9]", "9", low))
    runs = re.sub(r"9+", lambda m: f"9{len(m.group())}" if len(m.group()) < 6 else "9+", shape)
    bare = core.strip("()[]")
    host = bare.partition(":")[0]
    return (
        "runs=" + runs, "digits=" + str(min(len(digits), 20)), "form=" + re.sub(r"9+", "9", shape),
        "mail" if re.fullmatch(r"[^@]+@[^@]+\.[^@.]+", core) else "nomail", "ip" if re.fullmatch(r"[0-9]+(\.[0-9]+){3}", host) and ip_ok(host) else "noip", "luhn" if card_ok(core) else "noluhn",
    )


def sequence_features(words: list[str]) -> list[list[str]]:
    classes = [word_class(w) for w in words]
    edge: tuple[str, ...] = ("letters",)  # what stands around a text counts as a plain word
    return [
        [*("0:" + f for f in classes[k]), *("-1:" + f for f in (classes[k - 1] if k else edge)), *("+1:" + f for f in (classes[k + 1] if k + 1 < len(classes) else edge))]
        for k in range(len(words))
    ]


class Crf:
    """Weights of features by label and of transitions; a sequence starts after and ends before an O."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.features, self.weights, self.moves = features, weights, moves

    @classmethod
    def trained(cls, table: list[tuple[list[str], list[str]]], rounds: int = 120, rate: float = 0.5, decay: float = 1e-5, move_decay: float = 1e-3) -> Crf:
        names = [sequence_features(w) for w, _ in table]
        features = {f: k for k, f in enumerate(sorted({f for s in names for t in s for f in t}))}
        n, longest, y = len(table), max(len(s) for s in names), len(LABELS)
        width = max(len(t) for s in names for t in s)
        at = np.full((n, longest, width), len(features))  # the last row of the weights is padding
        gold, real = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, (s, (_, labels)) in enumerate(zip(names, table, strict=True)):
            for t, fs in enumerate(s):
                at[i, t, : len(fs)] = [features[f] for f in fs]
                gold[i, t], real[i, t] = LABELS.index(labels[t]), True
        weights, moves = np.zeros((len(features) + 1, y)), np.zeros((y, y))
        sums_w, sums_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
        before = np.concatenate([np.zeros((n, 1), int), gold[:, :-1]], axis=1)
        ends = gold[np.arange(n), real.sum(1) - 1]
        gold_moves = np.zeros((y, y))
        np.add.at(gold_moves, (before[real], gold[real]), 1)
        np.add.at(gold_moves, (ends, 0), 1)
        one_hot = np.eye(y)[gold] * real[..., None]
        for _ in range(rounds):
            scores = weights[at].sum(2)
            alpha = np.empty((n, longest, y))
            alpha[:, 0] = scores[:, 0] + moves[0]
            for t in range(1, longest):
                new = _logsum(alpha[:, t - 1, :, None] + moves[None], 1) + scores[:, t]
                alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
            total = _logsum(alpha[:, -1] + moves[:, 0], 1)
            beta = np.empty((n, longest, y))
            beta[:, -1] = moves[:, 0]
            for t in range(longest - 2, -1, -1):
                new = _logsum(moves[None] + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
                beta[:, t] = np.where(real[:, t + 1, None], new, beta[:, t + 1])
            chance = np.exp(alpha + beta - total[:, None, None]) * real[..., None]
            grad_w = np.zeros_like(weights)
            diff = np.repeat((one_hot - chance).reshape(-1, y), width, axis=0)
            for k in range(y):
                grad_w[:, k] = np.bincount(at.ravel(), diff[:, k], len(grad_w))
            grad_w[-1] = 0
            grad_m = gold_moves.copy()
            np.add.at(grad_m, (0,), -chance[:, 0].sum(0))
            for t in range(1, longest):
                pair = alpha[:, t - 1, :, None] + moves[None] + (scores[:, t] + beta[:, t])[:, None, :] - total[:, None, None]
                grad_m -= np.exp(pair[real[:, t]]).sum(0)
            grad_m[:, 0] -= chance[np.arange(n), real.sum(1) - 1].sum(0)
            for value, grad, sums, loss in ((weights, grad_w, sums_w, decay), (moves, grad_m, sums_m, move_decay)):
                grad = grad / n - loss * value
                sums += grad * grad
                value += rate * grad / np.sqrt(sums)
        return cls(features, weights[:-1].astype(np.float32), moves.astype(np.float32))

    def scores(self, classes: list[tuple[str, ...]], place: str) -> np.ndarray:
        """A row of label scores for each class of words that stands at ``place``."""
        get, none = self.features.get, len(self.weights)
        own = [[none, *(k for f in c if (k := get(place + f)) is not None)] for c in classes]
        starts = np.cumsum([0, *map(len, own[:-1])])
        weights = np.concatenate([self.weights, np.zeros((1, len(LABELS)), np.float32)])
        return np.add.reduceat(weights[[k for row in own for k in row]], starts, axis=0)

    def plain_margin(self, most: int = 60) -> int | None:
        """The p for which, in 2 p plain words among plain words, the p-th is O on every best path.

        All such words have one score by label, so the best sums over n words, from each label to
        each, are a max-plus power. If O at the p-th word beats every other label there, whatever
        stands before and at the end, then every word of a longer run with p words on either side is O.
        """
        own = sum(self.scores([("letters",)], p)[0] for p in PLACES)
        step = (self.moves + own[None, :]).astype(np.float64)
        power = step
        for p in range(1, most + 1):
            through = power[:, :, None] + power[None, :, :]  # before, at the p-th word, at the end
            if (through[:, 0] > through[:, 1:].max(1) + 1e-3).all():
                return p
            power = (power[:, :, None] + step[None, :, :]).max(1)
        return None


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def viterbi(scores: np.ndarray, sizes: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of sequences padded to one length: scores (n, length, labels), their sizes."""
    n, longest, y = scores.shape
    back = np.zeros((n, longest, y), np.int8)
    best = scores[:, 0] + moves[0]
    for t in range(1, longest):
        step = best[:, :, None] + moves[None]
        back[:, t] = step.argmax(1)
        new = step.max(1) + scores[:, t]
        on = t < sizes
        best = np.where(on[:, None], new, best)
        back[~on, t] = np.arange(y)
    out = np.zeros((n, longest), np.int64)
    out[:, -1] = (best + moves[:, 0]).argmax(1)
    for t in range(longest - 1, 0, -1):
        out[:, t - 1] = back[np.arange(n), t, out[:, t]]
    return out


class Tagger:
    """Labels the words of whole texts. Words fall into classes of equal features, whose scores are kept.

    Classes are forgotten between texts once there are ``cached`` of them; only a single text may have more.
    """

    def __init__(self, model: Crf, cached: int = 200_000):
        self.model, self.cached = model, cached
        self.words: dict[str, int] = {}
        self.fresh: list[tuple[str, ...]] = []
        self.classes: dict[tuple[str, ...], int] = {("letters",): 0}
        self.table = np.stack([model.scores([("letters",)], p) for p in PLACES])
        self.margin = model.plain_margin()

    def _class(self, word: str) -> int:
        own = word_class(word)
        k = self.classes.get(own)
        if k is None:
            k = self.classes[own] = len(self.classes)
            self.fresh.append(own)
        return k

    def _score_fresh(self) -> None:
        """Scores of the classes that came up since the last call, in one go."""
        at, n = len(self.classes) - len(self.fresh), len(self.classes)
        if n > self.table.shape[1]:
            self.table = np.concatenate([self.table, np.zeros((3, max(64, n), len(LABELS)), np.float32)], axis=1)
        for k, p in enumerate(PLACES):
            self.table[k, at:n] = self.model.scores(self.fresh, p)
        self.fresh = []

    def class_numbers(self, words: list[str]) -> np.ndarray:
        known = self.words
        try:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        except KeyError:
            if len(known) >= self.cached:
                known.clear()
            extra: dict[str, int] = {}  # very long words are not kept
            for w in words:
                if w not in known and w not in extra:
                    (known if len(w) <= LONGEST_WORD else extra)[w] = self._class(w)
            if self.fresh:
                self._score_fresh()
            return np.fromiter((known[w] if w in known else extra[w] for w in words), np.int64, len(words))

    def _forget(self) -> None:
        self.words.clear()
        self.classes = {("letters",): 0}
        self.table = self.table[:, :1].copy()

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, number of the kind, end) that the CRF finds in each text, unchecked."""
        out: list[list[tuple[int, int, int]]] = []
        numbers: list[np.ndarray] = []
        for text in texts:
            if len(self.classes) >= self.cached:  # the texts that have numbers of these classes are labelled before
                out += self._numbered_spans(texts[len(out) : len(out) + len(numbers)], numbers)
                numbers = []
                self._forget()
            numbers.append(self.class_numbers(text.split()))
        return out + self._numbered_spans(texts[len(out) :], numbers)

    def _numbered_spans(self, texts: list[str], numbers: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
        open_ = [(b - a, i, a) for i, at in enumerate(numbers) for a, b in self._stretches(at)]
        open_.sort()
        found: dict[int, list[tuple[int, int]]] = {}
        k = 0
        while k < len(open_):
            # Stretches of like size, of bounded cells in all.
            stop = k + 1
            while stop < len(open_) and 4 * open_[stop][0] <= 5 * open_[k][0] and (stop - k) * open_[stop][0] < 100_000:
                stop += 1
            self._label(numbers, open_[k:stop], found)
            k = stop
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for i, labels in found.items():
            places = [m.span() for m in re.finditer(r"\S+", texts[i])]
            label = dict(labels)
            for k in sorted(label):
                if label[k] % 2 == 1:
                    end = k
                    while label.get(end + 1) == label[k] + 1:
                        end += 1
                    out[i].append((places[k][0], (label[k] - 1) // 2, places[end][1]))
        return out

    def _stretches(self, at: np.ndarray) -> list[tuple[int, int]]:
        """Where labels are open: all words but those so far inside plain runs that they are O on every best path."""
        n = len(at)
        if self.margin is None or n == 0:
            return [(0, n)] if n else []
        reach = self.margin + 1
        live = np.flatnonzero(at)
        # The ends of the text count as words that are not plain.
        centres = np.concatenate([[-1], live, [n]])
        low, high = np.maximum(centres - reach, 0), np.minimum(centres + reach + 1, n)
        fresh = np.flatnonzero(low[1:] > high[:-1]) + 1
        return list(zip(low[np.concatenate([[0], fresh])].tolist(), high[np.concatenate([fresh - 1, [len(centres) - 1]])].tolist(), strict=True))

    def _label(self, numbers: list[np.ndarray], chosen: list[tuple[int, int, int]], found: dict[int, list[tuple[int, int]]]) -> None:
        sizes = np.array([n for n, _, _ in chosen])
        grid = np.zeros((len(chosen), int(sizes.max()) + 2), np.int64)  # a plain word stands before and after
        for row, (n, i, a) in enumerate(chosen):
            grid[row, 1 : n + 1] = numbers[i][a : a + n]
        scores = self.table[0][grid[:, 1:-1]] + self.table[1][grid[:, :-2]] + self.table[2][grid[:, 2:]]
        labels = viterbi(scores, sizes, self.model.moves)
        for row, at in zip(*np.nonzero(labels), strict=True):
            n, i, a = chosen[row]
            if at < n:
                found.setdefault(i, []).append((a + int(at), int(labels[row, at])))


_AT, _AT_END, _DOT = re.compile(r"@|[\[(]at[\])]", re.I), re.compile(r"(?:@|[\[(]at[\])])$", re.I), re.compile(r"\.|[\[(]dot[\])]", re.I)


def address_like(text: str) -> bool:
    """A name, at (as a sign, in brackets or as a word), a host, a dot (likewise) and an end, in time that grows with the text alone.

    Signs may stand by themselves; there is no other white space.
    """
    parts = text.split()
    bare = [p.lower().strip("[]()") for p in parts]
    if not 0 < len(parts) <= 5:
        return False
    if len(parts) == 5 and bare[1] == "at" and bare[3] == "dot":
        return True
    first = _AT.search(parts[0], 1)
    rests = [[parts[0][first.end() :], *parts[1:]]] if first else []
    if _AT_END.search(parts[0][-4:]) and not _AT_END.fullmatch(parts[0]):
        rests.append(parts[1:])
    if len(parts) > 1 and (sign := _AT.match(parts[1])):
        rests.append([parts[1][sign.end() :], *parts[2:]])
    elif len(parts) > 1 and bare[1] == "at":
        rests.append(parts[2:])
    for rest in rests:
        rest = rest[1:] if rest and not rest[0] else rest
        if len(rest) == 1 and _DOT.search(rest[0], 1) or len(rest) == 3 and rest[1].lower() == "dot":
            return True
    return False


_NUMBER = re.compile(r"[+(]?[0-9][0-9().\s/-]*[0-9]")
_CHECKS: tuple[Callable[[str], bool], ...] = (address_like, lambda t: ip_ok(t.partition(":")[0]) and t.count(".") == 3, lambda t: bool(_NUMBER.fullmatch(t)) and card_ok(t), lambda t: bool(_NUMBER.fullmatch(t)) and phone_ok(t))


def added_spans(text: str, base: list[tuple[int, int, int]], found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the CRF, trimmed of marks around them, that pass their kind's check and touch no span of the patterns.

    ``base`` is in order of starts; of the spans that start before a place, only the furthest end matters.
    """
    starts, reach = [a for a, _, _ in base], list(itertools.accumulate((b for _, _, b in base), max))
    out = []
    for a, kind, b in found:
        while a < b and text[a] in _TRIM + "[":
            a += 1
        while b > a and text[b - 1] in _TRIM + "]":
            b -= 1
        before = bisect.bisect_left(starts, b)
        if a < b and not (before and reach[before - 1] > a) and _CHECKS[kind](text[a:b]):
            out.append((a, kind, b))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with a mark in place of each span; spans that overlap become one, named after the first."""
    out, free = [], 0
    for a, kind, b in sorted(spans):
        if a >= free:
            out += [text[free:a], f"[{KINDS[kind].upper()}]"]
        free = max(free, b)
    return "".join([*out, text[free:]])


_model: list[Crf] = []


def trained_model() -> Crf:
    """The CRF of the labelled table, trained once in a driver."""
    if not _model:
        _model.append(Crf.trained(labelled_table()))
    return _model[0]


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted_text string"


def scanned(docs: DataFrame, *, text_col: str = "text", model: Crf | None = None, with_text: bool = True) -> DataFrame:
    """``docs`` with the columns of FOUND: counts and digest of the patterns' spans, all spans, and the text without them.

    Each row is scanned by itself, whole. Null texts count as empty and stay null in ``redacted_text``;
    columns of these names in ``docs`` are replaced; other columns, repeated rows and null ids pass
    unchanged; an empty table gives no rows. ``with_text=False`` leaves redacted_text null.
    """
    model = model or trained_model()
    added = T.StructType.fromDDL(FOUND)
    docs = docs.select(*[c for c in docs.columns if c not in added.names])
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                given = batch.column(place).to_pylist()
                texts = [t or "" for t in given]
                rows: list[list] = [[] for _ in added.names]
                for text, was, found in zip(texts, given, tagger.spans(texts), strict=True):
                    base = base_spans(text)
                    spans = base + added_spans(text, base, found)
                    count = [sum(k == kind for _, k, _ in base) for kind in range(4)]
                    clean = (redacted(text, spans) if was is not None else None) if with_text else None
                    for column, value in zip(rows, (*count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), clean), strict=True):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]], [*batch.schema.names, *added.names])

    return docs.mapInArrow(giving_back(run), T.StructType([*docs.schema, *added]))


def without_personal_data(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every span replaced by a mark such as [EMAIL]; other columns as they were, also those named as the operator's own."""
    given, names = docs.columns, T.StructType.fromDDL(FOUND).names
    docs, aside = put_aside(docs, names)
    text_col = aside.get(text_col, text_col)
    rows = scanned(docs, text_col=text_col, **options).withColumn(text_col, F.col("redacted_text"))
    return brought_back(rows, aside, names).select(*given)
