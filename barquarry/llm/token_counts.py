"""Token counts by heap-and-linked-list byte-pair merging (operator 7).

A text's count is the number of initial symbols of its words minus the merges done in them; no
token identifiers are made. Counts of words are kept for the words of a task, up to
``WORDS_KEPT``; the store is then emptied, which changes nothing but time.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.llm.common import kept_in_worker, map_texts, read

WORDS_KEPT = 1_000_000
TOKENIZER = "word_bpe_49k.json"
#: A document with more tokens than this is over the limit.
TOKEN_LIMIT = 2048


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {}, 0
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b] = chr(256 + extra)
            extra += 1
    return [letters[b] for b in range(256)]


def ascii_form(pattern: str) -> re.Pattern | None:
    """What the pattern is on ASCII texts, for the faster matcher that knows no Unicode classes; None if it asks for others than letters and digits."""
    for inside, plain in (("[\\p{L}]", "[A-Za-z]"), ("[\\p{N}]", "[0-9]"), ("[^\\s\\p{L}\\p{N}]", "[^\\sA-Za-z0-9]")):
        pattern = pattern.replace(inside, plain)
    return None if "\\p" in pattern or "\\P" in pattern else re.compile(pattern, re.ASCII)


class WordSplitter:
    """Normalisation and splitting of texts as the tokenizer file states them.

    Added tokens are found in the raw text. The rest is brought to NFC, lower-cased letter by
    letter and split; white space is dropped.
    """

    def __init__(self, spec: dict):
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if kinds != ["NFC", "Replace", "Lowercase"] or not (split["invert"] and split["behavior"] == "Removed"):
            raise ValueError("the tokenizer file has another normaliser or splitter")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.line_pattern = regex.compile("\n|" + split["pattern"]["Regex"])
        self.ascii_pattern = ascii_form(split["pattern"]["Regex"]) or self.pattern
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")")

    def words(self, text: str) -> tuple[list[str], list[str]]:
        """Words of the text in order, and the added tokens in it (see ``parts`` for their places)."""
        if not any(t in text for t in self.added):
            return self.plain_words(text), []
        words, added = [], []
        for i, part in enumerate(self.cut.split(text)):
            if i % 2:
                added.append(part)
            else:
                words += self.plain_words(part)
        return words, added

    def parts(self, text: str) -> list[str]:
        """Words and added tokens in order."""
        if not any(t in text for t in self.added):
            return self.plain_words(text)
        return [w for i, part in enumerate(self.cut.split(text)) for w in ([part] if i % 2 else self.plain_words(part))]

    def lines(self, texts: list[str]) -> list[str]:
        """Words of many texts without line ends, a line end after each text."""
        if any(t in text for text in texts if "<" in text for t in self.added):
            return [w for text in texts for w in (*self.parts(text), "\n")]
        if not texts:
            return []
        return [*self.line_pattern.findall(self.normal("\n".join(texts))), "\n"]

    def plain_words(self, text: str) -> list[str]:
        text = self.normal(text)
        return (self.ascii_pattern if text.isascii() else self.pattern).findall(text)

    def normal(self, text: str) -> str:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Letter by letter: the capital sigma has one lower form, wherever it stands.
        return text.replace("Σ", "σ").lower()


class MergeCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.splitter = WordSplitter(spec)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = [vocab[x] for x in letters]
        self.last = [vocab[x + end] for x in letters]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        self.kept: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of one word: repeatedly join the leftmost adjacent pair of lowest rank."""
        data = word.encode("utf-8")
        symbols = [self.inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merges = self.merges
        heap = []
        for i in range(n - 1):
            pair = (symbols[i], symbols[i + 1])
            if pair in merges:
                heap.append((merges[pair][0], i, pair))
        heapq.heapify(heap)
        count = n
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            # A symbol that was joined to its left is -1; changed neighbours make the entry stale.
            if symbols[i] != pair[0] or j >= n or symbols[j] != pair[1]:
                continue
            symbols[i], symbols[j] = merges[pair][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                new = (symbols[i], symbols[after[i]])
                if new in merges:
                    heapq.heappush(heap, (merges[new][0], i, new))
            if before[i] >= 0:
                new = (symbols[before[i]], symbols[i])
                if new in merges:
                    heapq.heappush(heap, (merges[new][0], before[i], new))
            count -= 1
        return count

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words, added = self.splitter.words(text)
        kept = self.kept
        try:
            return sum(map(kept.__getitem__, words)) + len(added)
        except KeyError:
            pass
        if len(kept) > WORDS_KEPT:
            kept.clear()
        for w in words:
            if w not in kept:
                kept[w] = self.word(w)
        return sum(map(kept.__getitem__, words)) + len(added)


def merge_counter(path: str) -> MergeCounter:
    """One per Python worker, for all tasks of a stage."""
    return kept_in_worker(("merge_counter", path), lambda: MergeCounter(path))


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text, ...).

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each; other columns
    are ignored; an empty table gives an empty result. Texts are never cut.
    """

    def make():
        counter = merge_counter(public_tokenizers.path(tokenizer))
        return lambda texts: [[len((t or "").encode("utf-8")) for t in texts], [counter.text(t) for t in texts]]

    counted = map_texts(docs, make, "n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"))
