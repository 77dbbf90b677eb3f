"""A Merkle manifest of a dataset with one multiproof per partition of leaves (operator 12).

Leaves of a source, in order, are hashed up in runs of three to the source's subroot, subroots likewise to the
root. The leaves are cut into partitions of consecutive blocks of 3^7 leaves (or whole smaller sources). A
partition derives all nodes over its own leaves; the only others its proofs call for are siblings on the way
from its edges to the root. These coordinates, the least union for all its leaves, are computed
from where the partition lies, fetched once by a join, and shared by the proofs of its leaves.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from barquarry.llm.common import read, stored

FANOUT = 3
#: Levels of the nodes that a block derives by itself, and the leaves of a full block.
BLOCK_LEVELS = 7
#: Partitions whose requests for one node travel as one row.
PARTS_AT_ONCE = 1024
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree over subroots; a source's own tree is named by an ``s`` and the source, or ``n`` for null.
TOP = "t"


def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def leaf_hash(**changed: Column) -> Column:
    """Digest of a row's fields, each ``-`` if null, else its byte count, a colon and the value; ``changed`` replaces fields."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def height(n: Column) -> Column:
    """Levels of runs between ``n`` leaves and one node."""
    return F.size(F.filter(F.array(*[F.lit(FANOUT**i) for i in range(39)]), lambda p: p < n))


def power(level: str) -> Column:
    return F.element_at(F.array(*[F.lit(FANOUT**i) for i in range(39)]), F.col(level) + 1)


def in_order(rows: DataFrame, order: list[str], run: str) -> DataFrame:
    """``rows`` sorted by ``order``, which starts with ``run``, with ``g`` (number over all) and ``pos`` (number in its run).

    Rows are parted by ranges of ``order`` and numbered inside the parts in one pass; what precedes a part, over all
    and of the run it starts with, comes from one row per part. No run is gathered in one task.
    """
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_row", F.monotonically_increasing_id())

    def number(batches):
        last, start = None, 0
        for batch in batches:
            at = batch.column("part_row").to_numpy()
            names = batch.column(run)
            if not len(at):
                continue
            codes = names.dictionary_encode(null_encoding="encode").indices.to_numpy()
            fresh = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            first = names[0].as_py()
            starts = at[fresh].copy()
            if last is not None and last[0] == first:
                starts[0] = start
            begin = np.repeat(starts, np.diff(np.concatenate([fresh, [len(at)]])))
            last, start = (names[len(at) - 1].as_py(),), int(starts[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at - begin, type=pa.int64())], names=[*batch.schema.names, "in_run"])

    numbered = stored(sorted_.mapInArrow(number, StructType([*sorted_.schema, StructField("in_run", LongType())])))
    numbered = numbered.withColumn("pid", F.shiftright("part_row", 33)).withColumn("k", F.col("part_row").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = numbered.groupBy("pid").agg(
        F.count("*").alias("n"), F.min_by(F.struct(run), "k").alias("first"), F.max_by(F.struct(run), "k").alias("last"), (F.max_by("in_run", "k") + 1).alias("n_last")
    )
    # One row per range partition, of which there are at most spark.sql.shuffle.partitions.
    every = Window.orderBy("pid")
    parts = parts.withColumn("so_far", F.sum("n_last").over(Window.partitionBy("last").orderBy("pid")))
    continues = F.lag("last").over(every).eqNullSafe(F.col("first"))
    parts = parts.select(
        "pid", (F.sum("n").over(every) - F.col("n")).alias("before"), F.when(continues, F.lag("so_far").over(every)).otherwise(F.lit(0)).alias("of_run")
    )
    joined = numbered.join(F.broadcast(parts), "pid")
    pos = F.col("in_run") + F.when(F.col("in_run") == F.col("k"), F.col("of_run")).otherwise(F.lit(0))
    return joined.select(*rows.columns, (F.col("before") + F.col("k")).alias("g"), pos.alias("pos"))


def climb(first: int, nodes: list[str], n: int, fetched: Callable[[int], dict[int, str]], most: int = 99) -> tuple[list[tuple[int, list[str]]], list[str]]:
    """Nodes over ``nodes`` (numbers ``first`` on, of ``n`` at their level), filled up to whole runs from ``fetched(level)``.

    Returns (first, nodes) of each level below the last one reached, and the nodes of that one.
    """
    levels: list[tuple[int, list[str]]] = []
    while n > 1 and len(levels) < most:
        extra = fetched(len(levels))
        end = first + len(nodes)
        a, b = first - first % FANOUT, min(-(-end // FANOUT) * FANOUT, n)
        nodes = [extra[i] for i in range(a, first)] + nodes + [extra[i] for i in range(end, b)]
        levels.append((a, nodes))
        nodes = [digest(nodes[i : i + FANOUT]) for i in range(0, len(nodes), FANOUT)]
        first, n = a // FANOUT, -(-n // FANOUT)
    return levels, nodes


def tree_nodes(leaves: DataFrame, n_most: int, step: int = BLOCK_LEVELS) -> DataFrame:
    """tree, level, idx, hash of all nodes over ``leaves`` (tree, idx, hash, n), themselves on level 0.

    Levels are made ``step`` at a time, in groups of at most 3^step nodes; a tree stops at its single node.
    """

    def up(base: int):
        def nodes(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("idx")
            first, n = int(group["idx"].iloc[0]), int(group["n"].iloc[0])
            levels, last = climb(first, list(group["hash"]), n, lambda _: {}, step)
            made = [(base + i, a + k, h) for i, (a, row) in enumerate(levels) if i for k, h in enumerate(row)]
            if levels:
                made += [(base + len(levels), first // FANOUT ** len(levels) + k, h) for k, h in enumerate(last)]
            out = pd.DataFrame(made, columns=["level", "idx", "hash"])
            return out.assign(tree=group["tree"].iloc[0])[["tree", "level", "idx", "hash"]]

        return nodes

    schema, every, base = "tree string, level int, idx long, hash string", [leaves.select("tree", F.lit(0).alias("level"), "idx", "hash")], 0
    while n_most > 1:
        size = FANOUT**step
        made = stored(leaves.groupBy("tree", F.floor(F.col("idx") / size)).applyInPandas(up(base), schema))
        every.append(made)
        base += step
        n_most = -(-n_most // size)
        counts = leaves.select("tree", F.ceil(F.col("n") / size).alias("n")).distinct()
        leaves = made.where(F.col("level") == base).join(counts.where("n > 1"), "tree").select("tree", "idx", "hash", "n")
    out = every[0]
    for more in every[1:]:
        out = out.unionAll(more)
    return out


@dataclass
class Manifest:
    """``leaves``: doc_id, source, leaf, claimed, tree, pos, part; ``sources``: tree, rank, n; ``nodes``: tree, level, idx, hash."""

    leaves: DataFrame
    sources: DataFrame
    nodes: DataFrame
    n_sources: int
    block_levels: int


def manifest(rows: DataFrame, block_levels: int = BLOCK_LEVELS) -> Manifest:
    """The tree over ``rows`` (doc_id, source, leaf, claimed); nodes of a source below ``block_levels`` are left to its blocks.

    In a source leaves ascend by doc_id (null first), then by their own digest: rows that are
    equal in all fields are interchangeable. Sources ascend bytewise, null first.
    """
    rows = stored(rows.select("doc_id", "source", "leaf", "claimed").withColumn("copy", F.monotonically_increasing_id()))
    placed = in_order(rows, ["source", "doc_id", "leaf", "copy"], "source")
    size = FANOUT**block_levels
    tree = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    part = F.floor((F.col("g") - F.col("pos") % size) / size)
    leaves = stored(placed.select(F.col("doc_id").cast("string").alias("doc_id"), "leaf", "claimed", tree.alias("tree"), "pos", "g", part.alias("part")))
    sources = stored(leaves.groupBy("tree").agg(F.count("*").alias("n"), F.min("g").alias("first")))
    found = sources.agg(F.count("*").alias("trees"), F.max("n").alias("most")).first()
    ranked = in_order(sources.withColumn("all", F.lit("a")), ["all", "first"], "all")
    sources = stored(ranked.select("tree", "n", F.col("pos").alias("rank")))

    def block_root(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        block = int(group["pos"].iloc[0]) // size
        # A short first block is a whole source; others have all levels.
        _, last = climb(0, list(group["leaf"]), len(group), lambda _: {}, block_levels)
        node = last[0]
        if block:
            for _ in range(block_levels - height_of(len(group))):
                node = digest([node])
        return pd.DataFrame({"tree": [group["tree"].iloc[0]], "idx": [block], "hash": [node]})

    blocks = leaves.groupBy("tree", F.floor(F.col("pos") / size)).applyInPandas(block_root, "tree string, idx long, hash string")
    blocks = stored(blocks.join(sources.select("tree", F.ceil(F.col("n") / size).alias("n")), "tree"))
    upper = tree_nodes(blocks, -(-(found["most"] or 0) // size), block_levels).withColumn("level", F.col("level") + block_levels)
    # A source's last node is its subroot.
    last = F.when(F.col("n") <= size, F.lit(block_levels)).otherwise(height(F.col("n")))
    subroots = upper.join(sources.withColumn("level", last), ["tree", "level"]).select(F.lit(TOP).alias("tree"), F.col("rank").alias("idx"), "hash", F.lit(found["trees"]).cast("long").alias("n"))
    nodes = stored(upper.unionAll(tree_nodes(stored(subroots), found["trees"], block_levels)))
    return Manifest(leaves, sources, nodes, found["trees"], block_levels)


def height_of(n: int) -> int:
    level = 0
    while n > 1:
        n, level = -(-n // FANOUT), level + 1
    return level


def missing(spans: DataFrame) -> DataFrame:
    """part, tree, level, idx: the siblings outside that leaves ``lo`` to ``hi`` of ``n`` call for, from level ``base`` up."""
    levels = spans.where(F.col("base") < height(F.col("n"))).withColumn("level", F.explode(F.sequence("base", height(F.col("n")) - 1)))
    lo, hi, n = (F.floor(F.col(c) / power("level")) for c in ("lo", "hi", "n"))
    n = n + F.when(F.col("n") % power("level") > 0, F.lit(1)).otherwise(F.lit(0))
    levels = levels.select("part", "tree", "level", lo.alias("lo"), hi.alias("hi"), n.alias("n"))
    start = F.col("lo") - F.col("lo") % FANOUT
    end = F.least(F.col("hi") - F.col("hi") % FANOUT + FANOUT, F.col("n"))
    none = F.array().cast("array<bigint>")
    left = F.when(start < F.col("lo"), F.sequence(start, F.col("lo") - 1)).otherwise(none)
    right = F.when(F.col("hi") + 1 < end, F.sequence(F.col("hi") + 1, end - 1)).otherwise(none)
    return levels.select("part", "tree", "level", F.explode(F.concat(left, right)).alias("idx"))


def proofs(m: Manifest) -> DataFrame:
    """doc_id (text), leaf, claimed, subroot, root, proof_sha256, folded_root, verified of each leaf."""
    spans = m.leaves.groupBy("part", "tree").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).join(m.sources, "tree")
    spans = stored(spans)
    tops = spans.groupBy("part").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    tops = tops.select("part", F.lit(TOP).alias("tree"), "lo", "hi", F.lit(m.n_sources).cast("long").alias("n"), F.lit(0).alias("base"))
    need = missing(spans.select("part", "tree", "lo", "hi", "n", F.lit(m.block_levels).alias("base")).unionAll(tops))
    # A node near the root is asked for by most partitions: their requests are bundled before the join.
    asked = need.groupBy("tree", "level", "idx", F.floor(F.col("part") / PARTS_AT_ONCE)).agg(F.collect_list("part").alias("parts"))
    fetched = asked.join(m.nodes, ["tree", "level", "idx"]).select(F.explode("parts").alias("part"), "tree", "level", "idx", "hash", F.lit(0).cast("long").alias("n"))
    known = spans.select("part", "tree", F.lit(-1).alias("level"), F.col("rank").alias("idx"), F.lit("").alias("hash"), "n").unionAll(fetched)
    n_sources = m.n_sources

    def expand(leaves: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        extra: dict[tuple[str, int], dict[int, str]] = {}
        trees = []
        for tree, level, idx, node, n in zip(info["tree"], info["level"], info["idx"], info["hash"], info["n"], strict=True):
            if level < 0:
                trees.append((idx, tree, n))
            else:
                extra.setdefault((tree, level), {})[idx] = node
        trees.sort()
        leaves = leaves.sort_values(["tree", "pos"])
        own = dict(iter(leaves.groupby("tree", sort=False)))
        climbed = [climb(int(own[t]["pos"].iloc[0]), list(own[t]["leaf"]), n, lambda i, t=t: extra.get((t, i), {})) for _, t, n in trees]
        top, (root,) = climb(trees[0][0], [last[0] for _, last in climbed], n_sources, lambda i: extra.get((TOP, i), {}))
        out = []
        for (rank, tree, _), (levels, (subroot,)) in zip(trees, climbed, strict=True):
            way = around(rank, top)
            for doc_id, leaf, claimed, pos in zip(own[tree]["doc_id"], own[tree]["leaf"], own[tree]["claimed"], own[tree]["pos"], strict=True):
                siblings, node = around(pos, levels) + way, claimed
                for left, right in siblings:
                    node = digest([left, node, right])
                out.append((doc_id, leaf, claimed, subroot, root, digest([x for pair in siblings for x in pair]), node, node == root))
        return pd.DataFrame(out, columns=["doc_id", "leaf", "claimed", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "doc_id string, leaf string, claimed string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return m.leaves.select("part", "doc_id", "leaf", "claimed", "tree", "pos").groupBy("part").cogroup(known.groupBy("part")).applyInPandas(expand, schema)


def around(i: int, levels: list[tuple[int, list[str]]]) -> list[tuple[str, str]]:
    """For each level, the joined siblings left and right of the node over number ``i``."""
    out = []
    for a, nodes in levels:
        k = i - a
        run = k - k % FANOUT
        out.append(("".join(nodes[run:k]), "".join(nodes[k + 1 : run + FANOUT])))
        i //= FANOUT
    return out


def verified(docs: DataFrame, text: Column, changed: Column, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """Proofs for all rows of ``docs``; where ``changed`` holds, the row's leaf is recomputed with ``text`` before it is folded.

    ``docs`` has the columns of documents, of which any value may be null; others are not read. Repeated rows are leaves of
    their own. An empty table gives an empty result.
    """
    leaf = leaf_hash()
    claimed = F.when(F.coalesce(changed, F.lit(False)), leaf_hash(text=text)).otherwise(leaf)
    out = proofs(manifest(docs.select("doc_id", "source", leaf.alias("leaf"), claimed.alias("claimed")), block_levels))
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    without = F.translate("text", "\n", "")
    return verified(docs, without, F.crc32(F.col("doc_id").cast("string")) % 2 == 0).drop("claimed")


def oracle() -> str:
    def leaf(text: str) -> str:
        values = [f"CAST({c} AS VARCHAR)" if c != "text" else text for c in FIELDS]
        return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}) || ':' || {v} END" for v in values) + ")"

    def up(name: str, start: str) -> str:
        return f"""
{name}(tree, level, idx, hash, n) AS (
  {start}
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(hash, '' ORDER BY idx)), (n + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY tree, level, idx // 3, n)"""

    def sides(name: str) -> str:
        run = "(PARTITION BY tree, level, idx // 3 ORDER BY idx ROWS BETWEEN"
        return f"""SELECT tree, level, idx, coalesce(string_agg(hash, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(hash, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name} WHERE n > 1"""

    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))))"""
    return f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS tree, {leaf("text")} AS leaf,
    CASE WHEN {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf("text")} END AS claimed
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),{up("lower", "SELECT tree, 0, pos, leaf, n FROM placed")},
subroots AS (SELECT tree, hash, row_number() OVER (ORDER BY tree) - 1 AS rank, count(*) OVER () AS n FROM lower WHERE n = 1),{up("upper_", "SELECT 't', 0, rank, hash, n FROM subroots")},
lower_sides AS ({sides("lower")}),
upper_sides AS ({sides("upper_")}),
ways AS (
  SELECT rid, level, l, r FROM placed p JOIN lower_sides s ON s.tree = p.tree AND s.idx = p.pos // CAST(pow(3, s.level) AS BIGINT)
  UNION ALL
  SELECT rid, 100 + level, l, r FROM placed p JOIN subroots b USING (tree) JOIN upper_sides s ON s.idx = b.rank // CAST(pow(3, s.level) AS BIGINT)),
joined AS (SELECT rid, string_agg(l || r, '' ORDER BY level) AS proof, list(l || '|' || r ORDER BY level) AS steps FROM ways GROUP BY rid),
folded AS (
  SELECT p.doc_id, p.leaf, b.hash AS subroot, (SELECT hash FROM upper_ WHERE n = 1) AS root, sha256(coalesce(j.proof, '')) AS proof_sha256,
    list_reduce(list_prepend(p.claimed, coalesce(j.steps, [])), lambda h, s: sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
  FROM placed p JOIN subroots b USING (tree) LEFT JOIN joined j USING (rid))
SELECT *, folded_root = root AS verified FROM folded
"""
