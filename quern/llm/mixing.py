"""Mixing sources to target weights by Pareto order sampling.

Each source has a word target. Within a source a document's expected copies are proportional to its weight, the number of
binary digits of its size, up to the most copies allowed, so that long documents are likelier than
fragments. The whole part of the expected copies is allocated for certain; the rest is an inclusion probability p,
which differs from document to document. Documents get random odds u / (1 - u), are ranked by random odds over inclusion
odds p / (1 - p), and the lowest ranks are taken until the sample has its fixed size in words. u is a digest of the id and a
seed, so reruns agree.

The prefix sum behind "until" is distributed. Ranks fall into cells of q / (1 + q), word sums per (source, cell) are
pre-aggregated, and the cell where the target is reached is divided again until it holds at most FEW rows or cannot be divided
further; only its rows are ordered exactly. A source that needs no sample is never ordered. Sources are
numbered and filled by aggregates over ranges, so no task holds all of them, nor a source.

Null texts have size 0; a null source is a source of its own, ranked last; a document without an id
draws by its text. Rows that repeat id and text share one draw and are taken or left together.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import maybe_broadcast, settle, text_or_empty

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
#: Cells of a division, as a power of two, and divisions at most.
CELL_BITS, DIVISIONS = 10, 5
#: Rows of a cell that are ordered in one task.
FEW = 4096
SEED = "mix-1"
#: Rows of a plan beyond this many are joined by a shuffle, not broadcast.
BROADCAST_PLAN = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` with their number from 0 in order of code points, null last: places in sorted ranges, plus the sizes of the ranges before."""
    t = settle(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before, offsets = 0, []
    for r in t.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row a range
        offsets.append((r["part"], before))
        before += r["count"]
    offsets = t.sparkSession.createDataFrame(offsets, "part long, before long")
    return t.withColumn("part", part).join(F.broadcast(offsets), "part").withColumn("number", F.col("before") + F.col("at") - F.shiftleft("part", 33)).drop("at", "part", "before")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target): `share` of all words by weight, filled up to the level where no target is above `most` sizes.

    The level rises while sources reach their caps; each step is one aggregate. All sums are of whole numbers, so their order is nothing.
    """
    cycle = F.array(*[F.lit(float(x)) for x in weights])
    t = numbered(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    t = t.withColumn("w", F.element_at(cycle, (F.col("number") % len(weights) + 1).cast("int"))).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    t = settle(t.select("source", "source_size", "w", "cap"))
    total = share * (t.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("w")
        row = t.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        new = (total - (row[0] or 0.0)) / row[1] if row[1] else float("inf")
        if new <= level:
            break
        level = new
        if not row[1]:
            break
    return t.select("source", "source_size", F.least("cap", F.lit(level) * F.col("w")).alias("target"))


def uniform(seed: str = SEED) -> Column:
    """A number in (0, 1) that depends on the document and the seed alone."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(text_or_empty(), 256)))
    return (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def size_of() -> Column:
    return F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long")


def weight_of(size: Column) -> Column:
    """Binary digits of a size."""
    return F.length(F.bin(size))


def draws(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, w, u): words, weight and the uniform number of each document."""
    return docs.select("doc_id", "source", size_of().alias("size"), uniform(seed).alias("u")).withColumn("w", weight_of(F.col("size")))


def sampling_plan(base: DataFrame, most: int = MOST_COPIES, **how) -> tuple[DataFrame, int]:
    """One row per source and weight: source_size, target, whole copies, p, and the source's words to sample; and the number of rows."""
    by_weight = settle(base.groupBy("source", "w").agg(F.sum("size").alias("words")))
    targets = source_targets(by_weight.withColumnRenamed("words", "size"), most=most, **how)
    n = by_weight.count()
    t = by_weight.alias("b").join(maybe_broadcast(targets, n, BROADCAST_PLAN).alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.*", "source_size", "target")
    # Expected copies are min(most, level * w); a source has at most 64 weights.
    heavy_first = Window.partitionBy("source").orderBy(F.desc("w"))
    before, onward, every = heavy_first.rowsBetween(Window.unboundedPreceding, -1), heavy_first.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy("source")
    share = F.sum(F.col("w") * F.col("words")).over(onward)
    level = F.when(share > 0, (F.col("target") - F.lit(float(most)) * F.coalesce(F.sum("words").over(before), F.lit(0))) / share)
    t = t.withColumn("level", level).withColumn("level", F.max("level").over(every))
    full = F.col("target") >= F.lit(float(most)) * F.col("source_size")
    t = t.withColumn("copies", F.when(full, F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("level") * F.col("w"))))
    t = t.withColumn("whole", F.floor("copies").cast("long")).withColumn("p", F.col("copies") - F.col("whole"))
    t = t.withColumn("rest", F.round("target").cast("long") - F.sum(F.col("whole") * F.col("words")).over(every))
    return settle(t.select("source", "w", "source_size", "target", "whole", "p", "rest")), n


def ranked(base: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """`base` with its row of `plan`, and where a sample is drawn the Pareto rank value q and `place`, q / (1 + q) in whole steps."""
    joined = base.alias("b").join(maybe_broadcast(plan, n, BROADCAST_PLAN).alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("b.w") == F.col("t.w")))
    q = F.when((F.col("p") > 0) & (F.col("rest") > 0), F.col("u") / (1 - F.col("u")) * ((1 - F.col("p")) / F.col("p")))
    steps = float(1 << (CELL_BITS * DIVISIONS))
    return joined.select("b.*", *[f"t.{c}" for c in plan.columns if c not in ("source", "w")], q.alias("q")).withColumn("place", F.floor(F.col("q") / (1 + F.col("q")) * steps))


def edges(rows: DataFrame, few: int = FEW) -> tuple[DataFrame, int, int]:
    """(source, cell, before) for each source with a sample: the cell where its words reach `rest`, and the words before it; the cells' shift; the number of sources."""
    found, n = None, 0
    drawn = rows.where("place is not null")
    for division in range(1, DIVISIONS + 1):
        shift = CELL_BITS * (DIVISIONS - division)
        if found is None:
            inside = drawn.withColumn("before", F.lit(0).cast("long"))
        else:
            inside = drawn.alias("r").join(maybe_broadcast(found, n, BROADCAST_PLAN).alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.shiftright("place", shift + CELL_BITS) == F.col("e.cell"))).select("r.*", "e.before")
        cells = inside.groupBy("source", F.shiftright("place", shift).alias("cell")).agg(F.sum("size").alias("words"), F.count("*").alias("rows"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cells = cells.withColumn("upto", F.col("before") + F.sum("words").over(upto))
        found = settle(cells.where("upto >= rest").groupBy("source").agg(F.min(F.struct("cell", (F.col("upto") - F.col("words")).alias("before"), "rows")).alias("e")).select("source", "e.*"))
        n, most = found.agg(F.count("*"), F.max("rows")).first()
        if (most or 0) <= few:
            break
    return found.select("source", "cell", "before"), shift, n


def placed(rows: DataFrame, found: DataFrame, shift: int, n: int) -> DataFrame:
    """`rows` with `side`: -1 in cells before their source's edge, 0 in it, 1 behind it or where nothing is drawn; and edge's `before`."""
    cell = F.shiftright("place", shift)
    both = rows.alias("r").join(maybe_broadcast(found, n, BROADCAST_PLAN).alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")), "left")
    side = F.when(cell < F.col("e.cell"), -1).when(cell == F.col("e.cell"), 0).otherwise(1)
    return both.select("r.*", side.alias("side"), F.col("e.before").alias("before"))


def mix(docs: DataFrame, few: int = FEW, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    The document on which the sample ends gives the words that are still missing, so each source's
    taken words add up to its rounded target.
    """
    base = settle(draws(docs))
    rows = ranked(base, *sampling_plan(base, **how))
    rows = placed(rows, *edges(rows, few))
    sure = rows.where("side != 0").withColumn("room", F.when(F.col("side") < 0, F.col("size")).otherwise(0))
    order = Window.partitionBy("source").orderBy("q").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ties = Window.partitionBy("source", "q")
    edge = rows.where("side = 0").withColumn("room", F.col("rest") - F.col("before") - (F.sum("size").over(order) - F.sum("size").over(ties)))
    both = sure.unionByName(edge)
    extra = F.greatest(F.lit(0), F.least("size", "room"))
    return both.select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, few: int = FEW, **how) -> DataFrame:
    """Rows of `docs`, each as often as the mix takes it: whole copies, plus one if it is in the Pareto sample.

    Here the sample takes whole documents: those whose middle word lies before the target. The decision is a function of the document and its
    source's plan, so texts are never shuffled.
    """
    base = settle(draws(docs))
    plan, n = sampling_plan(base, **how)
    rows = ranked(base, plan, n)
    found, shift, sources = edges(rows, few)
    order = Window.partitionBy("source").orderBy("q").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    edge = placed(rows, found, shift, sources).where("side = 0").withColumn("upto", F.col("before") + F.sum("size").over(order))
    last = edge.where(F.col("upto") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max("q").alias("last_q"))
    cut = settle(found.alias("f").join(last.alias("l"), F.col("f.source").eqNullSafe(F.col("l.source")), "left").select("f.*", F.coalesce("last_q", F.lit(-1.0)).alias("last_q")))
    full = docs.select(F.struct("*").alias("row"), "source", uniform().alias("u"), weight_of(size_of()).alias("w"))
    out = placed(ranked(full, plan, n), cut.select("source", "cell", F.col("last_q").alias("before")), shift, sources)  # here `before` is the last rank value that is in
    taken = (F.col("side") < 0) | ((F.col("side") == 0) & (F.col("q") <= F.col("before")))
    copies = F.col("whole") + F.coalesce(taken, F.lit(False)).cast("int")
    return out.where(copies > 0).select("row", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy")).select("row.*")


ORACLE = r"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'text:' || sha256(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
s1 AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w FROM s0),
s2 AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / w AS cap_ratio FROM s1),
s3 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap_ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap_ratio, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_k FROM s2),
s4 AS (SELECT source, source_size, least(cap, max(level_k) OVER () * w) AS target FROM s3),
b2 AS (SELECT *, length(bin(size)) AS w FROM base),
c0 AS (SELECT source, w, sum(size)::BIGINT AS words FROM b2 GROUP BY source, w),
c1 AS (SELECT c0.*, source_size, target, (target - 2.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY c0.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / nullif(sum(w * words) OVER (PARTITION BY c0.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS level_k
       FROM c0 JOIN s4 ON c0.source IS NOT DISTINCT FROM s4.source),
c2 AS (SELECT *, CASE WHEN target >= 2.0 * source_size THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, max(level_k) OVER (PARTITION BY source) * w) END AS copies FROM c1),
c3 AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p FROM c2),
c4 AS (SELECT *, round(target)::BIGINT - (sum(whole * words) OVER (PARTITION BY source))::BIGINT AS rest FROM c3),
r AS (SELECT b.*, c4.* EXCLUDE (source, w, words), CASE WHEN p > 0 AND rest > 0 THEN u / (1 - u) * ((1 - p) / p) END AS q
      FROM b2 b JOIN c4 ON b.source IS NOT DISTINCT FROM c4.source AND b.w = c4.w),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum(size) OVER (PARTITION BY source, q) AS before FROM r)
SELECT doc_id, size, source_size, target, (whole * size + CASE WHEN q IS NULL THEN 0 ELSE greatest(0, least(size, rest - before)) END)::BIGINT AS taken FROM c
"""
