"""SentencePiece encoding and decoding by batched Viterbi (operator 6).

A text is cut where no piece can cross (before a run of blanks); the distinct words of a batch are
encoded once. Words of equal length advance together: at each place the hashes of all substrings
ending there are looked up among the sorted hashes of the pieces, and the best predecessor is kept.
The segmentation has the greatest sum of piece scores; the last piece is the longest of equals. In a
merge-ranked vocabulary scores are negated ranks, so this can differ from replaying the merges.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barquarry.llm.common import kept_in_worker, map_texts, read

MODEL = "piece_bpe_32k.model"
WORDS_KEPT = 1_000_000
#: Codes of one batch of words that advance together, at most.
BATCH_CODES = 400_000
#: A character without a piece scores so much below the worst piece, as bytes.
UNKNOWN_PENALTY = 10.0
BLANK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: A word: blanks, then anything else; no piece has a blank behind another sign.
WORD = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def step_hash(before: np.ndarray, code: np.ndarray) -> np.ndarray:
    h = (before + code + np.uint64(1)) * _BASE
    return h ^ (h >> np.uint64(29))


class PieceCoder:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in every if model.is_byte(i)}
        special = [i for i in every if model.is_control(i) or model.is_unknown(i)]
        plain = [i for i in every if not (model.is_byte(i) or i in special or model.is_unused(i))]
        texts = [model.id_to_piece(i) for i in plain]
        if any(BLANK in t.lstrip(BLANK) for t in texts) or model.normalize(" x") != BLANK * 2 + "x":
            raise ValueError("the model has pieces across words or another normaliser")
        self.longest = max(map(len, texts))
        hashes = np.zeros(len(plain), dtype=np.uint64)
        for k, text in enumerate(texts):
            h = np.zeros(1, dtype=np.uint64)
            for c in text:
                h = step_hash(h, np.array([ord(c)], dtype=np.uint64))
            hashes[k] = h[0]
        order = np.argsort(hashes)
        self.keys = hashes[order]
        self.ids = np.array(plain, dtype=np.uint32)[order]
        self.sizes = np.array([len(t) for t in texts])[order]
        self.scores = np.array([model.get_score(i) for i in plain])[order]
        self.unknown = float(self.scores[self.scores > -1e8].min()) - UNKNOWN_PENALTY
        # What each id stands for, as bytes in one string.
        parts = [b""] * len(every)
        for i, text in zip(plain, texts, strict=True):
            parts[i] = text.replace(BLANK, " ").encode("utf-8")
        for b, i in self.bytes.items():
            parts[i] = bytes([b])
        self.part_sizes = np.array([len(p) for p in parts], dtype=np.int64)
        self.part_starts = np.concatenate([[0], np.cumsum(self.part_sizes)[:-1]])
        self.parts = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.kept: dict[str, bytes] = {}

    def viterbi(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Backpointers of words of one length: for each end, the size and key number of the last piece.

        Key number -1 stands for a character without a piece.
        """
        size = len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(words), size).astype(np.uint64)
        n = len(words)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0.0
        back_size = np.zeros((n, size + 1), dtype=np.int64)
        back_key = np.full((n, size + 1), -1, dtype=np.int64)
        window = np.zeros((n, 0), dtype=np.uint64)
        rows = np.arange(n)
        for j in range(1, size + 1):
            # Column k has the substring of k + 1 characters that ends here.
            window = step_hash(np.concatenate([np.zeros((n, 1), np.uint64), window[:, : self.longest - 1]], axis=1), codes[:, j - 1 : j])
            at = np.minimum(np.searchsorted(self.keys, window), len(self.keys) - 1)
            width = np.arange(1, window.shape[1] + 1)
            hit = (self.keys[at] == window) & (self.sizes[at] == width)
            value = np.where(hit, self.scores[at], -np.inf)
            value[:, 0] = np.where(hit[:, 0], value[:, 0], self.unknown)
            total = value + best[:, j - width]
            # Longest first, so that argmax takes the longest of equals.
            k = window.shape[1] - 1 - np.argmax(total[:, ::-1], axis=1)
            best[:, j] = total[rows, k]
            back_size[:, j] = k + 1
            back_key[:, j] = np.where(hit[rows, k], at[rows, k], -1)
        return back_size, back_key

    def learn(self, words: list[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w), []).append(w)
        for size, same in by_size.items():
            step = max(1, BATCH_CODES // (size * self.longest))
            for i in range(0, len(same), step):
                self._keep(same[i : i + step], *self.viterbi(same[i : i + step]))

    def _keep(self, words: list[str], back_size: np.ndarray, back_key: np.ndarray) -> None:
        """Follow the backpointers of all words together and keep their ids."""
        n, size = len(words), len(words[0])
        ids = np.zeros((n, size), dtype="<u4")
        keys = np.full((n, size), -1, dtype=np.int64)
        rows, at, column = np.arange(n), np.full(n, size), size
        pieces, plain = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
        while len(rows):
            column -= 1
            key = back_key[rows, at]
            keys[rows, column] = key
            ids[rows, column] = self.ids[key]
            plain[rows[key < 0]] = False
            pieces[rows] += 1
            at = at - back_size[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        data, width = ids.tobytes(), 4 * size
        for r, (word, k, whole) in enumerate(zip(words, pieces.tolist(), plain.tolist(), strict=True)):
            end = (r + 1) * width
            self.kept[word] = data[end - 4 * k : end] if whole else self._with_bytes(word, keys[r, size - k :])

    def _with_bytes(self, word: str, keys: np.ndarray) -> bytes:
        """Ids of a word that has characters without a piece, which become their bytes."""
        out: list[int] = []
        at = 0
        for key in keys.tolist():
            if key >= 0:
                out.append(int(self.ids[key]))
                at += int(self.sizes[key])
            else:
                out += [self.bytes[b] for b in word[at].encode("utf-8", "replace")]
                at += 1
        return np.array(out, dtype="<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null or empty text has none."""
        split = [WORD.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.kept) > WORDS_KEPT:
            self.kept.clear()
        kept = self.kept
        self.learn(list(set().union(*split).difference(kept)))
        return [b"".join(map(kept.__getitem__, words)) for words in split]

    def decode(self, data: bytes) -> str:
        """The text of a sequence of ids: bytes of all pieces, without the first blank."""
        ids = np.frombuffer(data, dtype="<u4")
        sizes = self.part_sizes[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.part_starts[ids] - (ends - sizes), sizes)
        text = self.parts[at].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def coder(path: str) -> PieceCoder:
    """One per Python worker, for all tasks of a stage."""
    return kept_in_worker(("pieces", path), lambda: PieceCoder(path))


def encode_pieces(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the ids (array<int>) of every text of ``docs``; null and empty texts have none."""

    def make():
        own = coder(public_tokenizers.path(model))
        return lambda texts: [[np.frombuffer(x, dtype="<i4") for x in own.encode(texts)]]

    return map_texts(docs, make, "ids array<int>")


def decode_pieces(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of every row of ``encoded`` (doc_id, ids); null ids give a null text."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    def run(batches):
        own = coder(public_tokenizers.path(model))
        for batch in batches:
            texts = [None if x is None else own.decode(np.asarray(x, dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    schema = StructType([encoded.schema["doc_id"], StructField("text", StringType())])
    return encoded.select("doc_id", "ids").mapInArrow(run, schema)


def piece_digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip for every row of ``docs`` (doc_id, text, ...).

    ids_crc32 is over little-endian unsigned 32-bit ids. round_trip: decoding the ids gives the text
    back (a text with the blank sign U+2581 itself gives blanks). A null or empty text has no
    pieces and round_trip true. Repeated rows are encoded each; other columns are ignored; an empty
    table gives an empty result.
    """

    def make():
        own = coder(public_tokenizers.path(model))

        def digests(texts):
            data = own.encode(texts)
            same = [own.decode(d) == (t or "").replace(BLANK, " ") for d, t in zip(data, texts, strict=True)]
            return [[len(d) // 4 for d in data], [zlib.crc32(d) for d in data], same]

        return digests

    return map_texts(docs, make, "n_pieces long, ids_crc32 long, round_trip boolean")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(read(spark, sf_dir, "documents"))
