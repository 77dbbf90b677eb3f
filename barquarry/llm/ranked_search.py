"""Ranked lexical search by range maxima over posting lists (operator 11).

Documents become postings of the queries' terms. A task indexes runs of documents: for each term its
posting list, in document order, with the score each posting adds, and a sparse table that answers where the greatest one
between two places lies. A query's best documents are then found best first: an interval of documents is bounded
by the sum of its terms' range maxima; the interval of the greatest bound is split at the document where a
term adds most, which is scored, and both remainders are bounded anew. The search ends when no
bound reaches the worst kept score. Runs of a task share the kept scores.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barquarry.llm.common import map_texts, read, stored

TOP = 10
#: Queries are worked in blocks of about so many terms, which tasks and driver hold.
MOST_TERMS = 200_000
#: Postings of one index, about; it takes some 80 bytes for each.
INDEX_POSTINGS = 500_000
#: Intervals of at most so many documents are scored document by document.
LEAF_DOCS = 64
#: Texts are split into words in pieces of about so many bytes.
PIECE_BYTES = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def word_counts(text: str) -> Counter:
    """Occurrences of each term of a text: maximal runs of ASCII letters and digits and of other characters, A-Z lower-cased."""
    raw = text.encode().lower()
    found: Counter = Counter()
    at = 0
    while at < len(raw):
        end = at + PIECE_BYTES
        # A piece ends with a whole word.
        rest = WORD.match(raw, end) if end < len(raw) else None
        end = rest.end() if rest else end
        found.update(WORD.findall(raw, at, end))
        at = end
    return found


def query_terms(items: DataFrame) -> DataFrame:
    """item (row number), item_id, terms (distinct) of each row that has a term."""

    def make():
        return lambda texts: ([[w.decode() for w in sorted(word_counts(t or ""))] for t in texts],)

    found = map_texts(items.select("item_id", "text"), make, "terms array<string>", keep=("item_id",))
    return stored(found.where(F.size("terms") > 0).withColumn("item", F.monotonically_increasing_id()))


def postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in the vocabulary), tfs of each document with a term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        known = sent.value

        def count(texts):
            n, terms, tfs = [], [], []
            for text in texts:
                found = word_counts(text or "")
                n.append(found.total())
                hits = [(known[w], tf) for w, tf in found.items() if w in known]
                terms.append([t for t, _ in hits])
                tfs.append([tf for _, tf in hits])
            return n, terms, tfs

        return count

    found = map_texts(docs, make, "n long, terms array<int>, tfs array<long>")
    return stored(found.where(F.col("n") > 0))


class Index:
    """Posting lists of a run of documents, one after the other, with one sparse table of range maxima over all."""

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, n_docs: int, n_terms: int) -> None:
        order = np.lexsort((docs, terms))
        self.docs, self.impacts, self.n_docs = docs[order], impacts[order], n_docs
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))
        self.keys = terms[order].astype(np.int64) * n_docs + self.docs
        longest = int(np.diff(self.first).max(initial=0))
        table = [np.arange(len(order), dtype=np.int32)]
        while 2 << len(table) - 1 <= longest:
            half = 1 << len(table) - 1
            left, right = table[-1][:-half], table[-1][half:]
            table.append(np.where(self.impacts[right] > self.impacts[left], right, left))
        # Rows of one length, so that places of several lengths are looked up at once.
        self.table = np.zeros((len(table), len(order)), dtype=np.int32)
        for level, row in enumerate(table):
            self.table[level, : len(row)] = row

    def maxima(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the greatest impact of each range [a, b) of one list stands; ranges are not empty."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        left, right = self.table[level, a], self.table[level, b - (1 << level)]
        return np.where(self.impacts[right] > self.impacts[left], right, left)

    def search(self, terms: np.ndarray, kept: list[tuple[int, int]], top: int, order: np.ndarray) -> list[tuple[int, int]]:
        """``kept`` (score, -order), at most ``top`` and greatest last, merged with this run's best documents.

        ``order`` ranks the run's documents ascending; of equal scores the smaller counts.
        """
        a, b = self.first[terms], self.first[terms + 1]
        best = list(kept)
        heapq.heapify(best)
        there = b > a
        heap: list[tuple] = []

        def offer(score: int, doc: int) -> None:
            if score > 0:
                found = (int(score), -int(order[doc]))
                if len(best) < top:
                    heapq.heappush(best, found)
                elif found > best[0]:
                    heapq.heapreplace(best, found)

        def push(lo: int, hi: int, terms_: np.ndarray, a_: np.ndarray, b_: np.ndarray) -> None:
            if not len(terms_):
                return
            if hi - lo <= LEAF_DOCS:
                at = np.concatenate([np.arange(x, y) for x, y in zip(a_, b_, strict=True)])
                total = np.zeros(hi - lo, dtype=np.int64)
                np.add.at(total, self.docs[at] - lo, self.impacts[at])
                worst = best[0][0] if len(best) == top else 1
                for k in np.flatnonzero(total >= worst):
                    offer(total[k], lo + k)
                return
            at = self.maxima(a_, b_)
            gains = self.impacts[at]
            bound = int(gains.sum())
            if len(best) < top or (bound, -int(order[lo])) > best[0]:
                heapq.heappush(heap, (-bound, lo, hi, terms_, a_, b_, int(self.docs[at[gains.argmax()]])))

        push(0, self.n_docs, terms[there], a[there], b[there])
        while heap:
            bound, lo, hi, terms_, a_, b_, doc = heapq.heappop(heap)
            if len(best) == top and -bound < best[0][0]:
                break
            if len(best) == top and (-bound, -int(order[lo])) <= best[0]:
                continue
            p = np.searchsorted(self.keys, terms_.astype(np.int64) * self.n_docs + doc)
            here = (p < b_) & (self.docs[np.minimum(p, len(self.docs) - 1)] == doc)
            offer(self.impacts[p[here]].sum(), doc)
            left, right = p > a_, p + here < b_
            push(lo, doc, terms_[left], a_[left], p[left])
            push(doc + 1, hi, terms_[right], (p + here)[right], b_[right])
        return best


def impacts(tf: np.ndarray, weight: np.ndarray, n: np.ndarray, n_docs: int, n_all: int) -> np.ndarray:
    """What postings add to a score; whole numbers throughout."""
    if n_docs * 90 * int(n.max(initial=0)) < 2**63:
        m = 10 + 90 * n * n_docs // n_all
    else:
        m = np.array([10 + 90 * int(x) * n_docs // n_all for x in n], dtype=np.int64)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


def best_of_runs(found: DataFrame, items: list, weights: np.ndarray, n_docs: int, n_all: int, top: int, index_postings: int) -> DataFrame:
    """item, doc_id, score: the ``top`` best documents of each task for each item of (number, term numbers)."""
    sent = found.sparkSession.sparkContext.broadcast((items, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = sent.value
        kept: list[list[tuple[int, int]]] = [[] for _ in queries]
        # Order of a document: its id, all null ids behind the greatest.
        ids: list[np.ndarray] = []
        terms, tfs, sizes, n = [], [], [], []
        held = 0
        null_id = 2**64

        def work() -> None:
            nonlocal ids, terms, tfs, sizes, n, held
            if not ids:
                return
            id_, length, count = np.concatenate(ids), np.concatenate(n), np.concatenate(sizes)
            by_id = np.argsort(np.array([x if x is not None else null_id for x in id_], dtype=object), kind="stable")
            place = np.empty(len(id_), dtype=np.int64)
            place[by_id] = np.arange(len(id_))
            doc = np.repeat(place, count)
            term, tf = np.concatenate(terms), np.concatenate(tfs)
            gain = impacts(tf, weight[term], np.repeat(length, count), n_docs, n_all)
            index = Index(term, doc, gain, len(id_), len(weight))
            order = np.array([x if x is not None else null_id for x in id_[by_id]], dtype=object)
            for i, (_, wanted) in enumerate(queries):
                kept[i] = index.search(wanted, kept[i], top, order)
            ids, terms, tfs, sizes, n, held = [], [], [], [], [], 0

        for batch in batches:
            step = max(1, index_postings // 256)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                lists, counts = part.column(2), part.column(3)
                ids.append(np.array(part.column(0).to_pylist(), dtype=object))
                n.append(part.column(1).to_numpy())
                sizes.append(np.diff(lists.offsets.to_numpy()))
                terms.append(lists.flatten().to_numpy())
                tfs.append(counts.flatten().to_numpy())
                held += len(terms[-1])
                if held >= index_postings:
                    work()
        work()
        rows = [(queries[i][0], None if -o == null_id else -o, s) for i, best in enumerate(kept) for s, o in best]
        columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["item", "doc_id", "score"])

    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "n", "terms", "tfs").mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, most_terms: int = MOST_TERMS, index_postings: int = INDEX_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``top`` best documents (doc_id, text) for each row of ``items`` (item_id, text).

    Null and empty texts have no terms: such documents are never found, such items give no rows. Rows of equal
    doc_id are documents of their own, rows of equal item_id items of their own. Equal scores go
    to the smaller doc_id, null last. Empty tables give an empty result; other columns are not read. Items are worked in blocks
    of about ``most_terms`` terms (a block has at least one item), each over all documents.
    """
    spark = docs.sparkSession
    asked = query_terms(items)
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = -(-n_terms // most_terms)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(max(1, blocks))))
    parts = []
    for block in range(blocks):
        rows = asked.where(F.col("block") == block).select("item", "terms").collect()
        if not rows:
            continue
        words = sorted({w for r in rows for w in r["terms"]})
        number = {w: i for i, w in enumerate(words)}
        found = postings(docs.select("doc_id", "text"), {w.encode(): i for w, i in number.items()})
        totals = found.agg(F.count("*").alias("docs"), F.sum("n").alias("all")).first()
        df = np.zeros(len(words), dtype=np.int64)
        for r in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        n_docs = totals["docs"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], dtype=np.int64)
        queries = [(r["item"], np.array([number[w] for w in r["terms"]], dtype=np.int64)) for r in rows]
        parts.append(best_of_runs(found, queries, weights, n_docs, totals["all"] or 1, top, index_postings))
    if not parts:
        parts = [spark.createDataFrame([], "item long, doc_id long, score long")]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionAll(more)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    every = every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return every.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH words AS (SELECT rid, doc_id, unnest(words) AS term, len(words) AS n
  FROM (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS words FROM documents)),
tf AS (SELECT rid, doc_id, term, n, count(*) AS tf FROM words GROUP BY ALL),
totals AS (SELECT count(DISTINCT rid) AS n_docs, count(*) AS n_all FROM words),
asked AS (SELECT DISTINCT iid, item_id, unnest(words) AS term
  FROM (SELECT row_number() OVER () AS iid, item_id, {_WORDS} AS words FROM benchmark)),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term),
scored AS (
  SELECT iid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_all)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term), totals GROUP BY ALL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM numbered WHERE rank <= {TOP}
"""
