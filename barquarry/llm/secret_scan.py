"""Secret scans with multipart credential linking (operator 8), in DataFrame functions only.

Three base patterns are reported wherever they stand. Other candidates are weak by themselves: a
temporary access identifier, a key without a name, an endpoint. A weak candidate is reported only if a
complementary part of a credential (identifier, secret, endpoint) stands within its scope and apart from it, which an
interval join over the candidates of a text decides. The scope is the block of text between blank lines, at
most ``SCOPE`` code points to either side.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barquarry.llm.common import read, stored

#: A complementary part may stand so many code points before or after a weak candidate, in the same block.
SCOPE = 400
#: What parts blocks.
BLANK_LINE = r"\n[\x20\x09\x0D]*\n"
#: Matches of a text that are worked on at once.
CHUNK = 256
IDENTIFIER, SECRET, ENDPOINT = 1, 2, 3
MASK = "[SECRET]"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: Group whose length is bounded, and the bounds (None: no upper one).
    group: int
    least: int
    most: int | None
    part: int
    base: bool


#: Base kinds in the order in which they are listed at equal starts, then weak kinds.
KINDS = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, None, SECRET, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, None, IDENTIFIER, True),
    # The longest runs are matched, so asking for 24 in the pattern drops the same ones as a later test.
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, None, SECRET, True),
    Kind("session", r"ASIA[A-Z0-9]+", 0, 20, None, IDENTIFIER, False),
    # Keys as services make them: 32 signs and more, also in base64.
    Kind("key", r"[A-Za-z0-9/+]{32,}={0,2}", 0, 32, 128, SECRET, False),
    Kind("endpoint", r"https?://[A-Za-z0-9._~:/?&=%@-]+", 0, 12, None, ENDPOINT, False),
)

SPAN = "array<struct<start:int,kind:int,end:int>>"


def in_chunks(rows: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Array of type ``kind`` with what ``step`` adds for each row, given a number carried on from 0.

    ``step(at, row)`` returns the next number and an array. Rows are folded a chunk at a time, so no long array is
    copied for every row.
    """
    none = F.array().cast(kind)

    def add(acc: Column, row: Column) -> Column:
        at, more = step(acc["at"], row)
        return F.struct(at.alias("at"), F.concat(acc["out"], more).alias("out"))

    def walk(acc: Column, chunk: Column) -> Column:
        done = F.aggregate(chunk, F.struct(acc["at"].alias("at"), none.alias("out")), add)
        # Bound once through a one-element array: used twice, it would be evaluated twice.
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out"))), F.lit(0))

    last = F.floor((F.size(rows) - 1) / F.lit(CHUNK)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(rows, i * CHUNK + 1, F.lit(CHUNK)))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.when(F.size(rows) > 0, F.flatten(F.aggregate(chunks, start, walk, lambda acc: acc["out"]))).otherwise(none)


def kind_spans(text: Column, number: int, kind: Kind) -> Column:
    """(start, kind, end) of each match, in code points, leftmost and not overlapping.

    The text is parted at the matches; the lengths of parts and matches add up to the places.
    """
    pattern = F.lit(kind.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    bounded = F.regexp_extract_all(text, pattern, F.lit(kind.group))
    gaps = F.split(text, kind.pattern, -1)
    rows = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), bounded.alias("bounded"))

    def step(at: Column, row: Column) -> tuple[Column, Column]:
        first = at + F.length(row["gap"])
        last = first + F.coalesce(F.length(row["hit"]), F.lit(0))
        fits = F.length(row["bounded"]) >= kind.least
        if kind.most is not None:
            fits = fits & (F.length(row["bounded"]) <= kind.most)
        span = F.struct(first.alias("start"), F.lit(number).alias("kind"), last.alias("end"))
        return last, F.when(fits, F.array(span)).otherwise(F.array().cast(SPAN))

    return F.when(text.rlike(kind.pattern), in_chunks(rows, SPAN, step)).otherwise(F.array().cast(SPAN))


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_base`` and ``_weak`` spans, ``_blanks`` (starts of blank lines), and ``_key``, the text's digest if there is anything to link."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.concat(*[kind_spans(text, i, k) for i, k in enumerate(KINDS) if k.base])
    weak = F.concat(*[kind_spans(text, i, k) for i, k in enumerate(KINDS) if not k.base])
    found = docs.withColumn("_base", F.sort_array(base)).withColumn("_weak", F.sort_array(weak))
    found = found.withColumn("_key", F.when((F.size("_weak") > 0) & (F.size("_base") + F.size("_weak") > 1), F.sha2(text, 256)))
    blank = Kind("blank", BLANK_LINE, 0, 0, None, 0, False)
    blanks = F.transform(kind_spans(text, 0, blank), lambda s: s["start"])
    return found.withColumn("_blanks", F.when(F.col("_key").isNotNull(), blanks))


def _of(kinds: list[int], column: Column, value) -> Column:
    out = F.lit(0 if not isinstance(value(KINDS[0]), bool) else False)
    for i in kinds:
        out = F.when(column == i, F.lit(value(KINDS[i]))).otherwise(out)
    return out


def linked(found: DataFrame) -> DataFrame:
    """_key and _linked: the weak spans of each text that a complementary part supports.

    Equal texts are linked once. Candidates meet by text and by stretch of ``SCOPE`` code points, so
    one long text with very many candidates is parted over many keys.
    """
    every = list(range(len(KINDS)))
    texts = found.where(F.col("_key").isNotNull()).select("_key", "_base", "_weak", "_blanks").dropDuplicates(["_key"])
    spans = texts.select("_key", "_blanks", F.explode(F.concat("_base", "_weak")).alias("s"))
    block = F.size(F.filter("_blanks", lambda b: b < F.col("s.start")))
    spans = spans.select("_key", block.alias("block"), "s.*").withColumn("part", _of(every, F.col("kind"), lambda k: k.part))
    weak = spans.where(~_of(every, F.col("kind"), lambda k: k.base))
    near = F.sequence(F.floor((F.col("start") - SCOPE) / SCOPE), F.floor((F.col("end") + SCOPE) / SCOPE))
    weak = weak.withColumn("cell", F.explode(near))
    other = spans.select("_key", "block", F.col("part").alias("o_part"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    other = other.withColumn("cell", F.explode(F.sequence(F.floor(F.col("o_start") / SCOPE), F.floor(F.col("o_end") / SCOPE))))
    close = (F.col("o_start") < F.col("end") + SCOPE) & (F.col("o_end") > F.col("start") - SCOPE)
    # A key inside an endpoint, say, is one thing and not two parts.
    apart = (F.col("o_start") >= F.col("end")) | (F.col("o_end") <= F.col("start"))
    pairs = weak.join(other, ["_key", "block", "cell"]).where((F.col("o_part") != F.col("part")) & close & apart)
    span = F.struct("start", "kind", "end")
    return pairs.groupBy("_key").agg(F.collect_set(span).alias("_linked"))


def spans_text(spans: Column) -> Column:
    name = lambda s: F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), s["kind"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked for every row of ``docs`` (doc_id, text, ...).

    A null text is empty; without a match counts are 0, spans is empty and base_sha256 that of the
    empty string. Repeated rows are scanned each; other columns are ignored; texts are read whole;
    an empty table gives an empty result. Spans are ordered by start, then kind, then end.
    """
    found = stored(candidates(docs.select("doc_id", "text")).drop("text"))
    both = _with_links(found)
    count = lambda i: F.size(F.filter("_base", lambda s: s["kind"] == i)).cast("long")
    return both.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(spans_text(F.col("_base")), 256).alias("base_sha256"),
        spans_text(F.col("_spans")).alias("spans"),
        F.size("_linked").cast("long").alias("n_linked"),
    )


def _with_links(found: DataFrame) -> DataFrame:
    """``found`` with ``_linked`` and ``_spans``; rows with nothing to link take no part in the join."""
    links = linked(found)
    lone = found.where(F.col("_key").isNull()).withColumn("_linked", F.array().cast(SPAN))
    some = found.where(F.col("_key").isNotNull()).join(links, "_key", "left")
    some = some.select(*found.columns, F.coalesce("_linked", F.array().cast(SPAN)).alias("_linked"))
    return lone.unionByName(some).withColumn("_spans", F.sort_array(F.concat("_base", "_linked")))


def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every reported span of the text replaced by ``mask``; overlapping spans become one.

    All rows and columns stay, whatever the columns are called; a null text stays null. Needs column text only.
    """
    # The row travels as one struct, so that its columns cannot clash with those added here. Candidates are read twice.
    both = _with_links(stored(candidates(docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row"), "text"))))
    text = F.col("text")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        # Places are counted from 0; a span that begins inside the one before prolongs it.
        fresh = s["start"] >= at
        more = F.array(F.substring(text, at + 1, s["start"] - at), F.lit(mask))
        return F.greatest(at, s["end"]), F.when(fresh, more).otherwise(F.array().cast("array<string>"))

    rest = F.substring(text, F.array_max(F.transform("_spans", lambda s: s["end"])) + 1, F.length(text))
    masked = F.concat(F.array_join(in_chunks(F.col("_spans"), "array<string>", step), ""), rest)
    new = F.when(F.size("_spans") > 0, masked).otherwise(text)
    return both.select(F.col("_row").withField("text", new).alias("_row")).select("_row.*")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read(spark, sf_dir, "documents"))


def oracle() -> str:
    """The same rows in DuckDB SQL: matches and places by splitting, links by a join over each text."""

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = []
    for i, k in enumerate(KINDS):
        pattern = quoted(k.pattern)
        most = f" AND length(g) <= {k.most}" if k.most is not None else ""
        parts.append(f"""
            SELECT rid, {i} AS kind, s AS start, s + length(h) AS "end" FROM (
              SELECT rid, h, g, sum(length(gap)) OVER (PARTITION BY rid ORDER BY i)
                     + coalesce(sum(length(h)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
              FROM (SELECT rid, unnest(range(len(hits))) AS i, unnest(hits) AS h, unnest(grp) AS g, unnest(gaps[:len(hits)]) AS gap
                    FROM (SELECT rid, regexp_extract_all(t, {pattern}, 0) AS hits, regexp_extract_all(t, {pattern}, {k.group}) AS grp,
                                 regexp_split_to_array(t, {pattern}) AS gaps FROM texts WHERE regexp_matches(t, {pattern}))))
            WHERE length(g) >= {k.least}{most}""")
    case = lambda f: "CASE kind " + " ".join(f"WHEN {i} THEN {f(k)}" for i, k in enumerate(KINDS)) + " END"
    name = case(lambda k: quoted(k.name))
    one = f"{name} || ':' || start || ':' || \"end\""
    return f"""
    WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
    spans AS MATERIALIZED ({" UNION ALL ".join(parts)}),
    blanks AS (
      SELECT rid, list(CAST(s AS BIGINT)) AS at FROM (
        SELECT rid, sum(length(gap)) OVER (PARTITION BY rid ORDER BY i)
               + coalesce(sum(length(h)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
        FROM (SELECT rid, unnest(range(len(hits))) AS i, unnest(hits) AS h, unnest(gaps[:len(hits)]) AS gap
              FROM (SELECT rid, regexp_extract_all(t, {quoted(BLANK_LINE)}, 0) AS hits, regexp_split_to_array(t, {quoted(BLANK_LINE)}) AS gaps FROM texts
                    WHERE rid IN (SELECT rid FROM spans)))) GROUP BY rid),
    marked AS (SELECT spans.*, {case(lambda k: k.part)} AS part, {case(lambda k: str(k.base))} AS base,
                      coalesce(len(list_filter(blanks.at, lambda x: x < spans.start)), 0) AS block FROM spans LEFT JOIN blanks USING (rid)),
    kept AS (
      SELECT *, false AS linked FROM marked WHERE base
      UNION ALL
      SELECT *, true FROM marked w WHERE NOT base AND EXISTS (
        SELECT 1 FROM marked o WHERE o.rid = w.rid AND o.block = w.block AND o.part <> w.part AND (o.start >= w."end" OR o."end" <= w.start)
        AND o.start < w."end" + {SCOPE} AND o."end" > w.start - {SCOPE})),
    summed AS (
      SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg({one}, ',' ORDER BY start, kind, "end") FILTER (base) AS base_text,
             string_agg({one}, ',' ORDER BY start, kind, "end") AS spans, count(*) FILTER (linked) AS n_linked
      FROM kept GROUP BY rid)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
           sha256(coalesce(base_text, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
    FROM texts LEFT JOIN summed USING (rid)
    """
