"""Exact top-k inner products by best-first search in M-trees (operator 5).

Vectors are parted among top-level routing objects, and each part into trees of bounded size. A
tree has pages of entries; every page knows its routing object, its covering radius and the distance
to the parent, every entry the distance to its page's object. For a query q, an object o at known
distance d from an object p and a radius r, no vector below o exceeds <q, p> + |q| (d + r), by the
triangle and Cauchy-Schwarz inequalities; so most inner products are never computed.

Bounds are floating-point numbers with an allowance relative to the norms; scores are whole numbers
throughout: products in doubles only where these hold every sum, else in 64 bits, else without a limit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from barquarry.llm.common import read, stored

SCALE = 64
TOP = 20
#: Top-level routing objects, chosen from a sample of about so many vectors.
ROUTES = 32
SAMPLE_ROWS = 2000
#: Vectors of a tree, entries of a page, and queries that meet a tree at once, about.
TREE_ROWS = 4096
PAGE_ENTRIES = 64
QUERY_BLOCK = 4096
#: Bounds are raised by this part of the product of the norms, far more than sums of doubles can be off.
ALLOWANCE = 1e-9
LONGEST = np.iinfo(np.int64).max


def whole_numbers(vector: str = "embedding", scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def usable(vector: str = "embedding") -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: F.coalesce(bad(x), F.lit(True)))


def spread_out(rows: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` different rows, each the farthest from those before it."""
    chosen = [int(np.argmax((rows.astype(np.float64) ** 2).sum(1)))]
    near = np.full(len(rows), np.inf)
    while len(chosen) < min(most, len(rows)):
        near = np.minimum(near, ((rows - rows[chosen[-1]]).astype(np.float64) ** 2).sum(1))
        if near.max() == 0:
            break
        chosen.append(int(np.argmax(near)))
    return rows[chosen]


def norms_of(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``a`` (few) and ``b``, from differences, so that near rows lose no digits."""
    out = np.empty((len(a), len(b)))
    for k, row in enumerate(a):
        out[k] = norms_of(b.astype(np.float64) - row.astype(np.float64))
    return out


def greatest_product(a: np.ndarray, b: np.ndarray) -> int:
    """No inner product of rows is further from 0, nor any sum on the way to it."""
    largest = lambda x: max(int(x.max()), -int(x.min())) if x.size else 0
    return largest(a) * largest(b) * a.shape[1]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: as 64-bit integers if all fit, else as Python's."""
    most = greatest_product(a, b)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    return a.astype(object) @ b.astype(object).T


@dataclass
class Tree:
    """A root object over pages; entries lie page by page, nearest to the page's object first."""

    root: np.ndarray
    objects: np.ndarray
    radius: np.ndarray
    to_root: np.ndarray
    first: np.ndarray
    vectors: np.ndarray
    to_object: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    longest: float


def build(vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> Tree:
    """Bulk load: vectors go to the nearest of some spread-out objects; full pages are parted again."""
    pages: list[tuple[np.ndarray, np.ndarray]] = []
    todo = [np.arange(len(vectors))]
    while todo:
        members = todo.pop()
        own = vectors[members]
        if len(members) <= PAGE_ENTRIES:
            # The medoid of a few candidates keeps the radius small.
            centre = own[np.argmin(distances(own[:8], own).max(1))]
            pages.append((centre, members))
            continue
        seeds = spread_out(own, min(16, -(-len(members) // PAGE_ENTRIES) + 1))
        if len(seeds) == 1:
            # Copies of one vector: pages of radius 0.
            pages += [(own[0], members[i : i + PAGE_ENTRIES]) for i in range(0, len(members), PAGE_ENTRIES)]
            continue
        near = distances(seeds, own).argmin(0)
        todo += [members[near == k] for k in range(len(seeds)) if (near == k).any()]
    root = vectors[np.argmin(distances(vectors[:16], vectors).max(1))]
    objects = np.stack([c for c, _ in pages])
    order, to_object = [], []
    for centre, members in pages:
        d = distances(centre[None], vectors[members])[0]
        at = np.argsort(d, kind="stable")
        order.append(members[at])
        to_object.append(d[at])
    first = np.concatenate([[0], np.cumsum([len(o) for o in order])])
    at = np.concatenate(order)
    return Tree(root, objects, np.array([d[-1] for d in to_object]), distances(root[None], objects)[0], first, vectors[at], np.concatenate(to_object), ids[at], rows[at], float(norms_of(vectors).max()))


def best_of(scores: np.ndarray, ids: np.ndarray, top: int) -> np.ndarray:
    """For each row the places of its ``top`` greatest scores, ties to the smaller id."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores), axis=1)[:, :top]
    return np.array([sorted(range(len(s)), key=lambda k: (-s[k], i[k]))[:top] for s, i in zip(scores, ids, strict=True)])


def search(tree: Tree, queries: np.ndarray, query_rows: np.ndarray, least: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``top`` best entries of the tree with a score of ``least`` or more.

    Returns query numbers, entry numbers and scores. Best first: each query takes its pages by falling bound
    and stops at the first bound under its worst kept score; queries at one page are served together.
    """
    n = len(queries)
    norms = norms_of(queries)
    slack = ALLOWANCE * norms * (tree.longest + 1.0) + 1e-9
    q = queries.astype(np.float64)
    most = greatest_product(queries, tree.vectors)
    exact = np.int64 if most < 2**62 else object
    # Under every score there can be.
    none = -most - 1
    scores = np.full((n, top), none, dtype=exact)
    places = np.full((n, top), -1, dtype=np.int64)
    ids = np.full((n, top), LONGEST)
    worst = least.astype(np.float64).copy()
    # From the root: no object's product is computed where the stored distances already exclude it.
    by_root = (q @ tree.root.astype(np.float64))[:, None] + norms[:, None] * (tree.to_root + tree.radius) + slack[:, None]
    bound = np.full(by_root.shape, -np.inf)
    product = np.full(by_root.shape, -np.inf)
    for page in range(len(tree.objects)):
        asked = np.flatnonzero(by_root[:, page] >= worst)
        if len(asked):
            product[asked, page] = q[asked] @ tree.objects[page].astype(np.float64)
            bound[asked, page] = product[asked, page] + norms[asked] * tree.radius[page] + slack[asked]
    order = np.argsort(-bound, axis=1, kind="stable")
    active = np.arange(n)
    for step in range(order.shape[1]):
        page_of = order[active, step]
        open_ = bound[active, page_of] >= worst[active]
        open_ &= bound[active, page_of] > -np.inf
        active, page_of = active[open_], page_of[open_]
        if not len(active):
            break
        for page in np.unique(page_of):
            a = active[page_of == page]
            lo, hi = tree.first[page], tree.first[page + 1]
            # Entries in order of distance: those before ``near`` are excluded for all queries here.
            reach = ((worst[a] - 2 * slack[a] - product[a, page]) / np.maximum(norms[a], 1e-12)).min()
            near = lo + int(np.searchsorted(tree.to_object[lo:hi], reach * (1 - ALLOWANCE) if reach > 0 else reach)) if np.isfinite(reach) else lo
            if near >= hi:
                continue
            new = products(queries[a], tree.vectors[near:hi]).astype(exact)
            new[query_rows[a][:, None] == tree.rows[None, near:hi]] = none
            new[new.astype(np.float64) < (least[a] - slack[a])[:, None]] = none
            at = np.broadcast_to(np.arange(near, hi), new.shape)
            s = np.concatenate([scores[a], new], axis=1)
            i = np.concatenate([ids[a], np.where(new == none, LONGEST, tree.ids[at])], axis=1)
            p = np.concatenate([places[a], np.where(new == none, -1, at)], axis=1)
            best = best_of(s, i, top)
            scores[a], ids[a], places[a] = (np.take_along_axis(x, best, 1) for x in (s, i, p))
            full = places[a][:, -1] >= 0
            worst[a] = np.where(full, np.maximum(worst[a], scores[a][:, -1].astype(np.float64) - slack[a]), worst[a])
    at, k = np.nonzero(places >= 0)
    return at, places[at, k], scores[at, k]


def top_products(vectors: DataFrame, is_query: Column, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score of the ``top`` greatest inner products of each query row.

    ``vectors`` has vec_id and a column ``v`` of whole numbers; ``is_query`` marks the query rows. Every
    row but the query's own is a candidate, ties go to the smaller vec_id. Vectors meet those of the
    same number of components only; those without any have the score 0. Rows of equal vec_id are different rows,
    and each gets its results as a query; rows without vec_id are candidates behind all others of the same score.
    Scores beyond 64 bits are ranked as they are and reported as the greatest or smallest long. Fewer rows than
    ``top`` give all; an empty table gives an empty result.
    """
    numbered = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<bigint>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    numbered = numbered.withColumns({"named": F.col("vec_id").isNotNull(), "vec_id": F.coalesce("vec_id", F.lit(LONGEST))})
    rows = stored(numbered.withColumn("row", F.monotonically_increasing_id()))
    rows = rows.withColumn("size", F.size("v"))
    total = rows.count()
    share = min(1.0, SAMPLE_ROWS / max(1, total))
    drawn = rows.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) / 1e6 < share).select("v", "size").collect()
    routes: dict[int, np.ndarray] = {}
    for size in {r["size"] for r in drawn}:
        own = [r["v"] for r in drawn if r["size"] == size]
        routes[size] = spread_out(np.array(own, dtype=np.int64).reshape(len(own), size), ROUTES)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            part["route"], part["far"] = 0, 0.0
            for size, own in part.groupby("size"):
                x = np.stack(own["v"]).astype(np.int64).reshape(len(own), size)
                d = distances(routes[size], x) if size in routes else norms_of(x)[None]
                part.loc[own.index, "route"] = d.argmin(0)
                part.loc[own.index, "far"] = d.min(0)
            yield part

    schema = StructType([*rows.schema, StructField("route", LongType()), StructField("far", DoubleType())])
    placed = stored(rows.mapInPandas(assign, schema))
    # At most ROUTES rows for each number of components.
    cells = {(r["size"], r["route"]): (r["n"], r["far"]) for r in placed.groupBy("size", "route").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    trees = {key: -(-n // TREE_ROWS) for key, (n, _) in cells.items()}
    parts = F.create_map(*[x for (size, route), n in trees.items() for x in (F.lit(f"{size}:{route}"), F.lit(n))]) if trees else F.create_map(F.lit(""), F.lit(1))
    cell = F.concat_ws(":", "size", "route")
    placed = placed.withColumn("tree", F.concat_ws(":", cell, F.pmod(F.xxhash64("row"), parts[cell])))

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        size = int(part["size"].iloc[0])
        part = part.sort_values("row")
        tree = build(np.stack(part["v"]).astype(np.int64).reshape(len(part), size), part["vec_id"].to_numpy(), part["row"].to_numpy())
        nameless = set(part["row"][~part["named"]])
        return pd.DataFrame({"tree": [part["tree"].iloc[0]], "pages": [pickle.dumps((tree, nameless))]})

    forest = stored(placed.groupBy("tree").applyInPandas(grow, "tree string, pages binary"))
    queries = placed.where("query").select("row", "vec_id", "v", "size", "route", "tree")
    n_queries = queries.count()
    blocks = -(-n_queries // QUERY_BLOCK) or 1
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)))
    out = "row long, vec_id long, found long, named boolean, score long, exact string"

    def visit(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        tree, nameless = pickle.loads(pages["pages"].iloc[0])
        q = np.stack(asked["v"]).astype(np.int64).reshape(len(asked), tree.vectors.shape[1])
        rows_, ids = asked["row"].to_numpy(), asked["vec_id"].to_numpy()
        at, found, score = search(tree, q, rows_, asked["least"].to_numpy(dtype=np.float64), top)
        named = np.array([row not in nameless for row in tree.rows[found].tolist()], dtype=bool) if nameless else np.ones(len(found), dtype=bool)
        large = score.dtype == object
        held = np.array([min(max(int(s), -LONGEST - 1), LONGEST) for s in score], dtype=np.int64) if large else score
        # Order among scores that a long cannot hold: their difference to what it can.
        exact = [f"{int(s)}" if large and int(s) != h else None for s, h in zip(score, held.tolist(), strict=True)]
        return pd.DataFrame({"row": rows_[at], "vec_id": ids[at], "found": tree.ids[found], "named": named, "score": held, "exact": pd.Series(exact, dtype=object)})

    def visited(asked: DataFrame) -> DataFrame:
        # A tree is sent to the blocks of queries that ask for it.
        pairs = asked.select(F.col("tree").alias("to"), F.col("block").alias("by")).distinct().join(forest.withColumnRenamed("tree", "to"), "to")
        return asked.groupBy("tree", "block").cogroup(pairs.groupBy("to", "by")).applyInPandas(lambda a, p: visit(p, a), out)

    # First each query's own tree: its worst result bounds all others.
    home = stored(visited(queries.withColumn("least", F.lit(float("-inf")))))
    below_long = F.coalesce(F.startswith("exact", F.lit("-")), F.lit(False))
    known_score = F.when(below_long, F.lit(float("-inf"))).otherwise(F.col("score").cast("double"))
    full = home.groupBy("row").agg(F.count("*").alias("n"), F.min(known_score).alias("s"))
    full = full.select("row", F.when(F.col("n") >= top, F.col("s")).otherwise(F.lit(float("-inf"))).alias("least"))
    known = queries.join(full, "row", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))

    def others(parts_: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts_:
            made = []
            for size, own in part.groupby("size"):
                x = np.stack(own["v"]).astype(np.float64).reshape(len(own), size)
                norm = np.sqrt((x**2).sum(1))
                least, own_tree = own["least"].to_numpy(), own["tree"].to_numpy()
                for (cell_size, route), n in trees.items():
                    if cell_size != size:
                        continue
                    o = routes[size][route].astype(np.float64) if size in routes else np.zeros(size)
                    far = cells[cell_size, route][1]
                    slack = ALLOWANCE * norm * (np.sqrt((o**2).sum()) + far + 1.0) + 1e-9
                    open_ = np.flatnonzero(x @ o + norm * far + 2 * slack >= least)
                    for k in range(n):
                        name = f"{size}:{route}:{k}"
                        to = own.iloc[open_[own_tree[open_] != name]]
                        made.append(to.assign(tree=name))
            yield pd.concat(made) if made else part.iloc[:0]

    asked = stored(known.select("row", "vec_id", "v", "size", "tree", "block", "least").mapInPandas(others, "row long, vec_id long, v array<bigint>, size int, tree string, block long, least double"))
    both = home.unionByName(visited(asked))
    # Whole numbers as text compare by sign, then length, then digits.
    text, below = F.col("exact"), F.startswith("exact", F.lit("-"))
    order = [F.desc("score"), F.desc(F.when(below, -F.length(text)).otherwise(F.length(text))), F.when(below, text), F.desc(F.when(~below, text))]
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(*order, F.desc("named"), "found")))
    ranked = ranked.where(F.col("rank") <= top)
    return ranked.select(F.col("vec_id").alias("query_id"), "rank", F.when(F.col("named"), F.col("found")).alias("vec_id"), "score")


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").where(usable())
    return top_products(rows.select("vec_id", whole_numbers().alias("v")), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON c.rid <> q.rid AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) <= 20
"""
