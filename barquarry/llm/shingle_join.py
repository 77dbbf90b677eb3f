"""Exact Jaccard join of word shingle sets as a metric-space join, and its groups (operator 4).

Jaccard distance is a metric, and any set x lies at distance 1 - 1/|x| from the one-element set of
each of its shingles and at distance 1 from those of all others. The one-element sets are the outer
pivots: a document belongs to the region of its first pivot in a common order (rare shingles first).
Documents within the radius of each other share one of the first |x| - ceil(s|x|) + 1 pivots of
each, so a document is also copied to the regions of these; no pair is lost. Inside a region the
documents lie near enough for real distances to tell them apart: bit vectors with
Hamming distance no greater than the symmetric difference of the sets give lower bounds, and the
triangle inequality against the empty set gives windows of sizes. Regions too large for a task are
parted again, pair by pair of parts. What is left is checked on the whole sets.

Pivots that are documents of the corpus alone cannot part it: nearly all documents are at distance
close to 1 from any of them, so windows of width 2r around the borders would hold everything.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from barquarry.llm.common import dropped, kept_in_worker, read, stored, text_slices, trimmed

SHINGLE_WORDS = 4
#: Two documents link when PERCENT or more of the union of their sets is shared.
PERCENT = 85
#: Documents whose shingles show which ones are common (this orders the pivots and changes no result).
SAMPLE_DOCS = 2000
#: Rows of a region that meet in one task; larger regions are parted.
REGION_ROWS = 20_000
#: Rows of regions that a task takes up at once, about.
WORK_ROWS = 40_000
#: Regions up to this size are compared many at a time.
SMALL_REGION = 64
#: Bits of the vectors of sets up to WIDE_FROM shingles, and of larger ones.
BITS, WIDE_BITS, WIDE_FROM = 512, 4096, 1024
#: Sets of more shingles have wide vectors once only rows that stand in a pair are left.
WIDE_AMONG_PAIRS_FROM = 64
#: Pairs of wide vectors that are compared at once.
WIDE_PAIRS = 20_000
#: Bits of the fixed-size filter for the documents whose sets are made again.
FILTER_BITS = 1 << 23
WORDS_KEPT = 200_000
#: Pairs that a task holds before it sends them on, about.
PAIRS_HELD = 200_000

_M = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of texts as sorted arrays of 64-bit shingle hashes; hashes of words are kept."""

    def __init__(self, size: int = SHINGLE_WORDS):
        self.size, self.kept = size, {}

    def set_of(self, text: str | None) -> np.ndarray:
        # Blanks of bytes.split are those that part words here, and lower() changes A-Z only.
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        kept = self.kept
        if len(kept) > WORDS_KEPT:
            kept.clear()
        for w in set(words).difference(kept):
            kept[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))
        width = min(self.size, len(words))
        n = len(words) - width + 1
        h = np.full(n, np.uint64(width), dtype=np.uint64)
        for k in range(width):
            h = mixed(h + codes[k : k + n])
        return np.unique(h)


def shingler(size: int) -> Shingler:
    """One per Python worker, for all tasks of a stage."""
    return kept_in_worker(("shingler", size), lambda: Shingler(size))


def bit_vector(own: np.ndarray, wide_from: int = WIDE_FROM) -> bytes:
    """Parities of the shingles by hash: the Hamming distance never exceeds the symmetric difference."""
    bits = WIDE_BITS if len(own) > wide_from else BITS
    odd = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def pivots_of(own: np.ndarray, common: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first pivots of a set: rarest first by the sample, then by hash."""
    n = len(own)
    width = n - (percent * n + 99) // 100 + 1
    if not len(common):
        return own[:width]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    rank = np.where(common[at] == own, counts[at], 0)
    if not rank.any():
        return own[:width]
    return own[np.lexsort((own, rank))[:width]]


def described(docs: DataFrame, size: int, percent: int, common: tuple[np.ndarray, np.ndarray], among: list[str]) -> DataFrame:
    """row, doc_id, digest (of the text), n, print (of the set), pivots and bits of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(common)
    key_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (known, counts) = shingler(size), shared.value
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in text_slices(texts, 1_000_000):
                sets = [own.set_of(t) for t in texts[a:b]]
                columns = [
                    pa.array(keys[a:b], type=key_type),
                    batch.column(2).slice(a, b - a),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([blake2b(s.tobytes(), digest_size=16).digest() for s in sets], type=pa.binary()),
                    pa.array([pivots_of(s, known, counts, percent).tobytes() for s in sets], type=pa.binary()),
                    pa.array([bit_vector(s) for s in sets], type=pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n", "print", "pivots", "bits"])
        trimmed()

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, digest long, n long, print binary, pivots binary, bits binary")
    return stored(made.withColumn("row", F.monotonically_increasing_id()), among)


def common_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that two or more documents of a bounded sample share, and in how many they are."""
    total = docs.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) / 1e6
    drawn = docs.where((place < SAMPLE_DOCS / max(1, total)) & (F.length("text") < 200_000)).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Shingler(size)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(own.set_of(t).view(np.int64))], names=["shingle"])

    # Only a sample's shingles are counted, and of them only the shared ones come to the driver.
    shared = drawn.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("c")).where("c > 1").collect()
    keys = np.array([r["shingle"] for r in shared], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], np.array([r["c"] for r in shared], dtype=np.int64)[order]


def regions(classes: DataFrame, percent: int, among: list[str]) -> DataFrame:
    """Rows (pivot, cell, low, node): the members of all regions with two or more of them.

    ``low`` is the region's first node, which regions of the same near copies have in common. A member
    stays only if the next smaller or the next larger set of its region has a size that it can link with.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
            sizes = [len(p) for p in parts]
            if sum(sizes):
                columns = [np.concatenate(parts), *(np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pivot", "node", "n"])

    # Dealt once by pivot; the count and the join below read the same shuffle.
    rows = classes.select("node", F.col("n").cast("int").alias("n"), "pivots").mapInArrow(spread, "pivot long, node long, n int").repartition("pivot")
    # Most pivots have one document; counting them first leaves little to move.
    # (Counting asks for all columns, so that it is the same shuffle.)
    full = rows.groupBy("pivot").agg(F.count("node").alias("members"), F.min("n").alias("least"), F.max("n").alias("most")).where("members > 1")
    # Two sets of sizes too far apart are no region.
    full = full.where((F.col("members") > 2) | (F.lit(100) * F.col("least") >= F.lit(percent) * F.col("most"))).select("pivot")
    by_size = Window.partitionBy("pivot").orderBy("n", "node")
    fits = (F.lit(100) * F.lag("n").over(by_size) >= F.lit(percent) * F.col("n")) | (F.lit(100) * F.col("n") >= F.lit(percent) * F.lead("n").over(by_size))
    shared = stored(rows.join(full, "pivot").withColumn("fits", fits).where(F.coalesce("fits", F.lit(False))).select("pivot", "node"), among)
    # Of pivots with the same documents (copies share many) one is enough: digests of the members tell them.
    digests = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"d{k}") for k in (1, 2)]
    sets = shared.groupBy("pivot").agg(F.count("node").alias("members"), F.min("node").alias("low"), *digests)
    first = sets.groupBy("members", "low", "d1", "d2").agg(F.min("pivot").alias("pivot")).select("pivot", "low", "members")
    members = shared.join(first, "pivot")
    parts = F.ceil(F.col("members") / REGION_ROWS).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    other = F.explode(F.when(parts > 1, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.lit(0))))
    # Each two parts of a large region meet in a cell of their own.
    cells = members.withColumn("_parts", parts).withColumn("_own", own).withColumn("_other", other)
    cell = F.least("_own", "_other") * F.col("_parts") + F.greatest("_own", "_other")
    return cells.select("pivot", cell.alias("cell"), "low", "node")


def bits_matrix(parts: list[bytes]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """All vectors folded to BITS (folding keeps the bound), and the wide ones as they are."""
    short, wide = np.zeros((len(parts), BITS // 64), dtype=np.uint64), {}
    for i, p in enumerate(parts):
        v = np.frombuffer(p, dtype=np.uint64)
        if len(v) > BITS // 64:
            wide[i] = v
            v = np.bitwise_xor.reduce(v.reshape(-1, BITS // 64), axis=0)
        short[i] = v
    return short, wide


def near(i: np.ndarray, j: np.ndarray, n: np.ndarray, short: np.ndarray, wide: dict[int, np.ndarray], percent: int) -> np.ndarray:
    """Whether the pairs can link: by their sizes, and by the bound on the symmetric difference."""
    small, large = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    ok = 100 * small >= percent * large
    both = (100 - percent) * (n[i] + n[j])
    at = np.flatnonzero(ok)
    apart = np.bitwise_count(short[i[at]] ^ short[j[at]]).sum(axis=1, dtype=np.int64)
    ok[at] = both[at] >= (100 + percent) * apart
    if wide:
        at = np.flatnonzero(ok)
        at = at[[a in wide and b in wide for a, b in zip(i[at].tolist(), j[at].tolist(), strict=True)]] if len(at) else at
        for k in range(0, len(at), WIDE_PAIRS):
            own = at[k : k + WIDE_PAIRS]
            a, b = (np.stack([wide[x] for x in side[own].tolist()]) for side in (i, j))
            ok[own] = both[own] >= (100 + percent) * np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return ok


class Ties:
    """Which rows are tied to each other so far: equal labels. Labels of merged groups are rewritten."""

    def __init__(self, label: np.ndarray) -> None:
        self.label, self.groups = label, len(np.unique(label))

    def merge_row(self, i: int, j: np.ndarray) -> np.ndarray:
        """Tie row i to the rows j, none of which it is tied to; one of j for each group that joins it."""
        others, at = np.unique(self.label[j], return_index=True)
        self.label[self.label == others[0] if len(others) == 1 else np.isin(self.label, others)] = self.label[i]
        self.groups -= len(others)
        return j[at]

    def merge(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Tie the pairs; numbers of those that tied what was apart."""
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        chosen = []
        for k, (a, b) in enumerate(zip(self.label[i].tolist(), self.label[j].tolist(), strict=True)):
            a, b = top(a), top(b)
            if a != b:
                parent[b] = a
                chosen.append(k)
        if chosen:
            old = np.array(sorted(parent))
            new = np.array([top(x) for x in old.tolist()])
            at = np.minimum(np.searchsorted(old, self.label), len(old) - 1)
            self.label = np.where(old[at] == self.label, new[at], self.label)
        return np.array(chosen, dtype=np.int64)


def region_pairs(start: np.ndarray, n: np.ndarray, parts: list[bytes], root: np.ndarray, percent: int, spanning: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of the same region that can link and have different roots, a slice at a time.

    ``start`` marks the first row of each region; rows of a region are ordered by size. ``spanning``: a row
    is not compared with those that earlier pairs of its region tie it to, so a region gives fewer pairs than rows.
    """
    short, wide = bits_matrix(parts)
    first = np.flatnonzero(start)
    sizes = np.diff(np.append(first, len(start)))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def full() -> bool:
        return sum(len(i) for i, _ in held) >= PAIRS_HELD

    def taken() -> tuple[np.ndarray, np.ndarray]:
        i, j = (np.concatenate([pair[k] for pair in held]) for k in (0, 1))
        held.clear()
        return i, j

    def keep(i: np.ndarray, j: np.ndarray, ties: Ties | None) -> None:
        apart = root[i] != root[j]
        if ties is not None:
            apart &= ties.label[i] != ties.label[j]
        i, j = i[apart], j[apart]
        ok = near(i, j, n, short, wide, percent)
        i, j = i[ok], j[ok]
        if ties is not None and len(i):
            at = ties.merge(i, j)
            i, j = i[at], j[at]
        if len(i):
            held.append((i, j))

    # Rows of different regions are different vertices, so one labelling serves all small regions; equal roots are tied from the start.
    region = np.cumsum(start)
    _, tied = np.unique(np.column_stack([region, root]), axis=0, return_inverse=True)
    last = np.repeat(first + sizes, sizes)
    small = np.repeat(sizes <= SMALL_REGION, sizes)
    ties = Ties(tied.reshape(-1).astype(np.int64)) if spanning else None
    for k in range(1, int(min(SMALL_REGION, sizes.max(initial=0)))):
        i = np.flatnonzero(small & (np.arange(len(start)) + k < last))
        if not len(i):
            break
        keep(i, i + k, ties)
        if full():
            yield taken()
    for f, size in zip(first[sizes > SMALL_REGION], sizes[sizes > SMALL_REGION], strict=True):
        own = n[f : f + size]
        ties = Ties(tied.reshape(-1)[f : f + size].copy()) if spanning else None
        # The triangle inequality with the empty set: sizes of linked sets lie in a window.
        ends = np.searchsorted(own, own * 100 // percent, side="right")
        for i in range(size):
            if ends[i] == i + 1:
                continue
            if ties is None:
                j = np.arange(f + i + 1, f + ends[i])
                keep(np.full(len(j), f + i), j, None)
            else:
                # Once all rows are tied nothing is left to compare.
                if ties.groups == 1:
                    break
                j = i + 1 + np.flatnonzero(ties.label[i + 1 : ends[i]] != ties.label[i])
                j = j[near(np.full(len(j), f + i), f + j, n, short, wide, percent)]
                if len(j):
                    j = ties.merge_row(i, j)
                    held.append((np.full(len(j), f + i), f + j))
            if full():
                yield taken()
    if held:
        yield taken()


def candidates(members: DataFrame, percent: int, spanning: bool) -> DataFrame:
    """Distinct pairs (a, b) of nodes, a < b, that can link and have different roots.

    ``members`` are rows of regions with columns root, n and bits. ``spanning``: of each region only
    pairs that connect it, so a dense region makes fewer pairs than it has members. Regions of the same
    near copies mostly give the same pairs; an eighth of them meet in a task, which sends each once.
    """
    meeting = ["low", "cell", F.pmod("pivot", F.lit(8))]
    members = members.repartition(*meeting).sortWithinPartitions("low", "cell", "pivot", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            region = np.column_stack([table["pivot"].to_numpy(), table["cell"].to_numpy()])
            start = np.ones(len(region), dtype=bool)
            start[1:] = (region[1:] != region[:-1]).any(axis=1)
            node, root = table["node"].to_numpy(), table["root"].to_numpy()
            for i, j in region_pairs(start, table["n"].to_numpy(), table["bits"].to_pylist(), root, percent, spanning):
                pairs = np.unique(np.column_stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if sum(b.num_rows for b in held) < WORK_ROWS:
                continue
            # The last region of the rows at hand may go on in the next batch.
            table = pa.Table.from_batches(held)
            pivot, cell = table["pivot"].to_numpy(), table["cell"].to_numpy()
            same = (pivot == pivot[-1]) & (cell == cell[-1])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                yield from work(table.slice(0, cut).combine_chunks())
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from work(pa.Table.from_batches(held))
        trimmed()

    return members.select("pivot", "cell", "node", "n", "bits", "root").mapInArrow(run, "a long, b long").distinct()


def sets_in(pairs: DataFrame, docs: DataFrame, classes: DataFrame, size: int, among: list[str]) -> DataFrame:
    """The sets that stand in a pair: node, shingles, n, bits.

    They are made again from the texts of the documents; a fixed-size bit filter, built by an aggregate, keeps the
    other texts from being moved.
    """
    spark = docs.sparkSession
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    asked = stored(classes.select("node", "doc_id", "print").join(nodes, "node"), among)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)) + 1
    cells = asked.select(F.bitmap_bucket_number(place).alias("k"), F.bitmap_bit_position(place).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("bits"))
    flags = np.zeros(FILTER_BITS, dtype=bool)
    for r in cells.collect():
        part = np.unpackbits(np.frombuffer(bytes(r["bits"]), dtype=np.uint8), bitorder="little")
        flags[(r["k"] - 1) * len(part) : r["k"] * len(part)] = part
    shared = spark.sparkContext.broadcast(np.packbits(flags))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, wanted = shingler(size), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(wanted[batch.column(0).to_numpy()]))
            texts = batch.column(1).to_pylist()
            for a, b in text_slices(texts, 1_000_000):
                sets = [own.set_of(t) for t in texts[a:b]]
                prints = [blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                columns = [prints, [s.tobytes() for s in sets], [bit_vector(s, WIDE_AMONG_PAIRS_FROM) for s in sets]]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.binary()) for c in columns], names=["print", "shingles", "bits"])
        trimmed()

    made = docs.select((place - 1).alias("place"), "text").mapInArrow(run, "print binary, shingles binary, bits binary")
    sets = made.join(asked.select("node", "print"), "print").select("node", "shingles", (F.length("shingles") / 8).cast("long").alias("n"), "bits")
    return stored(sets.dropDuplicates(["node"]), among)


def linked(pairs: DataFrame, sets: DataFrame, percent: int, among: list[str]) -> DataFrame:
    """The pairs whose whole sets share enough."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, type=pa.bool_()))
        trimmed()

    found = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")
    return stored(found.mapInArrow(check, "a long, b long"), among)


def components(links: DataFrame, among: list[str]) -> DataFrame:
    """node and root (the smallest node it is connected with) of every node in ``links`` (a < b).

    Alternates large-star and small-star steps until nothing changes; each step is a grouped
    minimum (combined before the shuffle) and a join, so a hot node is no single group. Tables of a step
    go when the next one is done.
    """
    spark, last, before = links.sparkSession, [], None
    edges = stored(links.select("a", "b").distinct(), last)
    while True:
        own: list[str] = []
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # Larger neighbours are tied to the smallest of the neighbourhood, then smaller ones too.
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), last)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), own)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(spark, last)
        last = own
        if tuple(state) == before:
            break
        before = tuple(state)
    # Now stars: b is tied to its root a alone.
    among += last
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", F.col("a").alias("root")).distinct())


def rooted(members: DataFrame, roots: DataFrame) -> DataFrame:
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def grouped(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT, among: list[str] | None = None) -> DataFrame:
    """doc_id, digest, n_shingles, component_id, row and group of every row of ``docs`` (doc_id, text, ...).

    component_id is the smallest doc_id that links reach. Null and empty texts, and texts of blanks,
    have no shingle, are linked with nothing and are groups of their own. Equal sets are linked
    always; repeated rows are one group. Other columns are ignored; texts are read whole; an empty
    table gives an empty result. The paths of the tables that the result reads are added to ``among``.
    """
    among = [] if among is None else among
    every = described(docs, size, percent, common_shingles(docs, size), among)
    full = every.where("n > 0")
    # One node for each distinct set: its first row. All that follows is about nodes.
    first = stored(full.groupBy("print").agg(F.min("row").alias("node"), F.min("doc_id").alias("low")), among)
    # Tables that only lead to the links are dropped when these are known.
    scratch, wide = [], []
    classes = full.withColumnRenamed("row", "node").join(first.select("node"), "node", "left_semi")
    members, sizes = stored(regions(classes, percent, wide), wide), full.select(F.col("row").alias("node"), "n", "bits")
    pairs = stored(candidates(members.join(sizes, "node").withColumn("root", F.col("node")), percent, spanning=True), scratch)
    sets = sets_in(pairs, docs, classes, size, scratch)
    roots = components(linked(pairs, sets, percent, scratch), scratch)
    # Every row that can link with another of its region stands in a pair by now: the others leave the regions. What is
    # left has vectors that tell sets near the limit apart.
    members = stored(members.join(sets.select("node", "n", "bits"), "node"), scratch)
    dropped(docs.sparkSession, wide)
    # Regions whose members are not all in one group yet are compared again, across groups only: first by pairs that
    # connect them, so that groups with many links between them become one by a few, then in full.
    for spanning in (True, False):
        now = rooted(members, roots)
        apart = now.groupBy("pivot", "cell").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("pivot", "cell")
        rest = stored(candidates(now.join(apart, ["pivot", "cell"]), percent, spanning), scratch)
        more = linked(rest.join(pairs, ["a", "b"], "left_anti"), sets, percent, scratch)
        pairs = pairs.unionAll(rest)
        if not more.isEmpty():
            tied = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
            roots = components(tied.union(more), scratch)
    roots = stored(roots, among)
    dropped(docs.sparkSession, scratch)
    named = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("print", F.col("root").alias("group"), "component_id")
    columns = ["doc_id", "digest", F.col("n").alias("n_shingles"), "component_id", "row", "group"]
    out = full.select("doc_id", "digest", "n", "print", "row").join(named, "print").select(*columns)
    lone = every.where("n = 0").withColumns({"component_id": F.col("doc_id"), "group": -1 - F.col("row")}).select(*columns)
    return out.unionByName(lone)


def shingle_groups(docs: DataFrame, size: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``; see ``grouped``."""
    return grouped(docs, size, percent).select("doc_id", "n_shingles", "component_id")


def one_of_each_group(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """One row of ``docs``, with all columns, for each group of near copies: one of its smallest doc_id.

    Rows without a shingle all stay.
    """
    made: list[str] = []
    rows = stored(grouped(docs, size, percent, made))
    dropped(docs.sparkSession, made)
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    kept = rows.groupBy("group").agg(lead.alias("k")).select("k.row").join(rows, "row")
    # Texts are known by id and digest; rows repeated under the same two are told apart at the end.
    again = rows.where("n_shingles > 0").groupBy("doc_id", "digest").agg((F.count("*") > 1).alias("again"))
    keys = kept.select("doc_id", "digest").distinct().alias("k")
    keys = stored(keys.join(again.alias("g"), F.col("k.doc_id").eqNullSafe(F.col("g.doc_id")) & F.col("k.digest").eqNullSafe(F.col("g.digest")), "left").select("k.doc_id", "k.digest", F.coalesce("again", F.lit(False)).alias("again")))
    mark = f"_{uuid.uuid4().hex}"  # no column of the documents has this name
    texts = docs.withColumn(mark, F.xxhash64("text"))

    def those(own: DataFrame) -> DataFrame:
        own = own.select(F.col("doc_id").alias("_doc_id"), F.col("digest").alias("_own"))
        return texts.join(own, texts["doc_id"].eqNullSafe(own["_doc_id"]) & texts[mark].eqNullSafe(own["_own"]), "left_semi")

    once = those(keys.where("NOT again"))
    more = those(keys.where("again")).dropDuplicates(["doc_id", mark])
    return once.unionByName(more).select(*docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_groups(read(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS rid, doc_id,
         [w for w in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') if w <> ''] AS w
  FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT rid, s FROM (
    SELECT rid, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                            ELSE [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)] END) AS s FROM texts)),
sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
shared AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL),
links AS MATERIALIZED (
  SELECT x, y FROM shared JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT rid AS x, rid AS y FROM texts UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
lowest AS (SELECT reach.x AS rid, min(t.doc_id) AS component_id FROM reach JOIN texts t ON t.rid = reach.y GROUP BY reach.x)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM texts LEFT JOIN sizes USING (rid) JOIN lowest USING (rid)
"""
