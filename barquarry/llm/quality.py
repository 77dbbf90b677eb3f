"""Quality rules with line labelling by a linear-chain conditional random field (operator 3).

Lines of a text are described by binned features. Viterbi decoding marks each line as content or
boilerplate; a text whose words mostly stand in content lines is kept. Plain base rules (too few
words, too many repeated ones) come first.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from barquarry.llm.common import filter_texts, labelled_sample, map_texts, read

#: Labelled documents of each quality that the field is fitted on, at most.
TRAINING_DOCS = 1000
#: Least share of a text's words in content lines for it to be kept.
CONTENT_SHARE = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = "#*$%&|<>"
CONTENT, BOILERPLATE = 0, 1

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

#: Bounds of the bins of each line feature, in the order of ``line_values``.
BINS = (
    (1, 3, 6, 12, 40),  # words
    (2, 3.5, 5, 7, 10, 16),  # characters per word
    (0.01, 0.03, 0.08, 0.2, 0.5),  # share of symbols
    (0.05, 0.15, 0.4, 0.8),  # share of capitals
    (0.01, 0.05, 0.15),  # share of exclamation and question marks
    (0.02, 0.1, 0.3),  # share of digits
    (0.3, 0.5, 0.7, 0.8),  # share of letters
    (0.1, 0.3, 0.5, 0.7),  # share of words seen before in the line
    (0.05, 0.2, 0.5),  # share of words equal to the one before
    (0.5,),  # line equals an earlier one
)
N_FEATURES = sum(len(b) + 1 for b in BINS)


def character_classes() -> np.ndarray:
    """Class of each code point: 1 symbol, 2 capital, 3 other letter, 4 digit, 5 exclamation or question mark."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x110000):
        x = chr(c)
        table[c] = 2 if x.isupper() else 3 if x.isalpha() else 4 if x.isdigit() else 5 if x in "!?" else 1 if x in SYMBOLS else 0
    return table


CLASSES = character_classes()


def repeated_words(words: list[str]) -> int:
    """Words covered by windows of ``REPEAT_WINDOW`` words that occur twice or more in the list."""
    n = len(words)
    if n <= REPEAT_WINDOW:
        return 0
    numbers: dict[str, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=n)
    if len(numbers) == n:
        return 0
    # Windows of 2, then 4, then 5 words are numbered exactly by pairing smaller ones.
    two = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1]
    four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
    _, five, count = np.unique(four[:-1] * len(numbers) + ids[4:], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(count[five] > 1)
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + REPEAT_WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


@dataclass
class Described:
    words: int
    word_chars: int
    symbols: int
    dup_lines: int
    repeated: int
    #: Bin numbers, one row per line with a word; and the words of these lines.
    lines: np.ndarray
    line_words: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.words < MIN_WORDS or 100 * self.repeated > MAX_REPEAT_PERCENT * self.words


def describe(text: str | None) -> Described:
    """Counts of the whole text and binned features of its lines."""
    text = text or ""
    # Only \n parts lines; other line signs are blanks like any.
    lines, seen, dup, all_words = text.split("\n"), set(), 0, []
    values, counts = [], []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = CLASSES[codes] if len(codes) else np.empty(0, np.uint8)
    at = 0
    spans = []
    for line in lines:
        words = WORD.findall(line)
        if words:
            again = line in seen
            dup += again
            seen.add(line)
            all_words += words
            chars = sum(map(len, words))
            adjacent = sum(map(str.__eq__, words, words[1:]))
            values.append((len(words), chars / len(words), chars, 1 - len(set(words)) / len(words), adjacent / len(words), again))
            counts.append(len(words))
            spans.append((at, at + len(line)))
        at += len(line) + 1
    n_words = len(all_words)
    word_chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    binned = np.empty((0, len(BINS)), dtype=np.int64)
    if values:
        v = np.array(values, dtype=np.float64)
        edges = np.array(spans, dtype=np.int64)
        shares = []
        for kind in (1, 2, 5, 4, (2, 3)):
            hits = np.isin(kinds, kind) if isinstance(kind, tuple) else kinds == kind
            total = np.concatenate([[0], np.cumsum(hits)])
            shares.append((total[edges[:, 1]] - total[edges[:, 0]]) / v[:, 2])
        columns = [v[:, 0], v[:, 1], *shares, v[:, 3], v[:, 4], v[:, 5]]
        binned = np.column_stack([np.digitize(c, b) for c, b in zip(columns, BINS, strict=True)])
    return Described(n_words, word_chars, symbols, dup, repeated_words(all_words), binned, np.array(counts, dtype=np.int64))


#: Place of each feature's first bin in the weight vector.
OFFSETS = np.concatenate([[0], np.cumsum([len(b) + 1 for b in BINS])[:-1]])


@dataclass
class Field:
    """Weights of the chain: per bin and label, per pair of neighbouring labels, per first label."""

    emission: np.ndarray
    transition: np.ndarray
    first: np.ndarray

    def line_scores(self, lines: np.ndarray) -> np.ndarray:
        return self.emission[lines + OFFSETS].sum(axis=1)

    def decode(self, lines: np.ndarray) -> np.ndarray:
        """Most likely labels of the lines (Viterbi); ties go to content."""
        scores = self.line_scores(lines)
        n = len(scores)
        if not n:
            return np.empty(0, dtype=np.int64)
        t = self.transition.tolist()
        rows = scores.tolist()
        a, b = self.first[0] + rows[0][0], self.first[1] + rows[0][1]
        back = []
        for x, y in rows[1:]:
            from_a = 0 if a + t[0][0] >= b + t[1][0] else 1
            from_b = 0 if a + t[0][1] >= b + t[1][1] else 1
            back.append((from_a, from_b))
            a, b = (a + t[0][0] if not from_a else b + t[1][0]) + x, (a + t[0][1] if not from_b else b + t[1][1]) + y
        label = CONTENT if a >= b else BOILERPLATE
        labels = [label]
        for pair in reversed(back):
            label = pair[label]
            labels.append(label)
        return np.array(labels[::-1])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_field(texts: list[np.ndarray], labels: list[np.ndarray], steps: int = 80, rate: float = 0.5, penalty: float = 1e-3) -> Field:
    """Maximum likelihood by Adagrad; chains of a batch are padded and run side by side."""
    longest = 64
    pieces = [(x[i : i + longest], y[i : i + longest]) for x, y in zip(texts, labels, strict=True) for i in range(0, len(x), longest)]
    n, width = len(pieces), max(len(x) for x, _ in pieces)
    lines = np.zeros((n, width, len(BINS)), dtype=np.int64)
    marks, mask = np.zeros((n, width), dtype=np.int64), np.zeros((n, width), dtype=bool)
    for i, (x, y) in enumerate(pieces):
        lines[i, : len(x)], marks[i, : len(x)], mask[i, : len(x)] = x + OFFSETS, y, True
    weights = [np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2)]
    history = [np.full_like(w, 1e-6) for w in weights]
    total = mask.sum()
    one = np.eye(2)
    pairs = mask[:, 1:]
    for _ in range(steps):
        emission, transition, first = weights
        scores = emission[lines].sum(axis=2)
        forward = np.zeros((n, width, 2))
        forward[:, 0] = scores[:, 0] + first
        for j in range(1, width):
            step = log_sum(forward[:, j - 1, :, None] + transition, 1) + scores[:, j]
            forward[:, j] = np.where(mask[:, j, None], step, forward[:, j - 1])
        norm = log_sum(forward[:, -1], 1)
        backward = np.zeros((n, width, 2))
        for j in range(width - 2, -1, -1):
            step = log_sum(transition + (scores[:, j + 1] + backward[:, j + 1])[:, None, :], 2)
            backward[:, j] = np.where(mask[:, j + 1, None], step, backward[:, j + 1])
        node = np.exp(forward + backward - norm[:, None, None]) * mask[..., None]
        residual = (one[marks] - node) * mask[..., None]
        edge = np.exp(forward[:, :-1, :, None] + transition + (scores + backward)[:, 1:, None, :] - norm[:, None, None, None])
        seen = one[marks[:, :-1]][..., None] * one[marks[:, 1:]][:, :, None, :]
        slope = [np.zeros((N_FEATURES, 2)), ((seen - edge) * pairs[..., None, None]).sum((0, 1)), residual[:, 0].sum(0)]
        flat = lines[mask]
        for k in range(len(BINS)):
            for label in (0, 1):
                slope[0][:, label] += np.bincount(flat[:, k], weights=residual[mask][:, label], minlength=N_FEATURES)
        for k in range(3):
            g = slope[k] / total - penalty * weights[k]
            history[k] += g * g
            weights[k] = weights[k] + rate * g / np.sqrt(history[k])
    return Field(*weights)


def train(rows: list[tuple[str, int]], rounds: int = 3) -> Field:
    """The field from texts labelled as a whole (1 good, 0 bad).

    Lines of good texts are content. Lines of bad texts begin as boilerplate and are labelled anew
    by each round's field, save that a bad text always keeps its least content-like line.
    """
    described = [(describe(t), y) for t, y in rows]
    described = [(d, y) for d, y in described if len(d.lines)]
    lines = [d.lines for d, _ in described]
    labels = [np.full(len(d.lines), CONTENT if y == 1 else BOILERPLATE) for d, y in described]
    if len({y for _, y in described}) < 2:
        return Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)), np.zeros(2))
    field = fit_field(lines, labels)
    for _ in range(rounds - 1):
        for i, (d, y) in enumerate(described):
            if y == 0:
                labels[i] = field.decode(d.lines)
                scores = field.line_scores(d.lines)
                labels[i][np.argmax(scores[:, BOILERPLATE] - scores[:, CONTENT])] = BOILERPLATE
        field = fit_field(lines, labels)
    return field


class Judge:
    def __init__(self, field: Field):
        self.field = field

    def share(self, d: Described) -> float:
        """Share of the words that stand in content lines."""
        if not d.words:
            return 0.0
        return float(d.line_words[self.field.decode(d.lines) == CONTENT].sum() / d.words)

    def rows(self, texts: list[str | None]) -> list[list]:
        out = []
        for text in texts:
            d = describe(text)
            share = self.share(d)
            failed = d.base_failed
            out.append((d.words, d.word_chars, d.symbols, d.dup_lines, d.repeated, failed, not failed and share >= CONTENT_SHARE, share))
        return [list(c) for c in zip(*out, strict=True)]

    def kept(self, texts: list[str | None]) -> list[bool]:
        return self.rows(texts)[6]


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judged_by(field: Field, docs: DataFrame) -> Callable[[], Judge]:
    shared = docs.sparkSession.sparkContext.broadcast(field)
    return lambda: Judge(shared.value)


def quality(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, counts, base_failed, kept and content_share for every row of ``docs`` (doc_id, text, ...).

    Null and empty texts have no words: all counts 0, base_failed, not kept. Repeated rows are judged
    each; other columns are ignored; texts are read whole; an empty table gives an empty result.
    """
    make = judged_by(field, docs)
    return map_texts(docs, lambda: make().rows, SCHEMA)


def keep_quality(docs: DataFrame, field: Field) -> DataFrame:
    """The rows of ``docs``, all columns, that are kept."""
    make = judged_by(field, docs)
    return filter_texts(docs, lambda: make().kept)


def trained(spark: SparkSession, sf_dir: str) -> Field:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    return train(labelled_sample(docs, labels, "quality", TRAINING_DOCS, seed=3))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), trained(spark, sf_dir))
