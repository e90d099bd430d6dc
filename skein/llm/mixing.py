"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every source has a token target. Among all document rates between 0 and ``cap`` that meet the
targets, entropy balancing takes those closest to 1 in (bounded) relative entropy; the minimiser is
an exponential tilt, rate = cap e^u / (cap - 1 + e^u) with u = lambda * size / mean size, one dual
variable lambda per source. The dual is convex, and distributed Newton iterations with a bracket
solve all sources at once. Documents of equal source and size have equal rates, so iterations run
over cells (source, size, documents), never over texts or documents. Rates are rounded to copies by
running sums over a source's cells from the largest size down; what then is missing or left over is
corrected from the largest fitting size down, and a cell's copies go to its documents by hash order.

Targets: sources ranked by code point, null last, weigh 1, 2, 3, repeating; they share all tokens by
weight, none above ``cap`` times its own, the excess reshared by weight until none is above.

Cases: null text has size 0 and takes 0; a source without tokens has target 0; the null source is
one more source; repeated rows are documents of their own; reruns give equal results, as order comes
from hashes of doc_id; an empty table gives an empty result; other columns are kept by ``mixed``.
The table of sources (one row each, after aggregation) is ranked in one task, and the table of cells
has at most as many rows in a source as it has distinct sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, table, written

CAP = 3
CYCLE = 3
#: Newton stops at this relative error of every source's tokens, or after so many rounds.
TOLERANCE, ROUNDS = 1e-6, 40
#: Documents of a cell that are ranked together.
BUCKET = 512
#: A table of source states up to this many rows is broadcast (about 100 bytes each); a larger one is joined by shuffle.
SMALL_SOURCES = 20_000


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(cells: DataFrame, cap: int = CAP) -> DataFrame:
    """source, source_size, docs, target: by water filling in the order of cap * size / weight."""
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("weight", (F.pmod(rank - 1, F.lit(CYCLE)) + 1).cast("double"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    levels = weighed.withColumn("level", (total - before) / left)
    level = F.max("level").over(Window.partitionBy())
    return levels.select("source", "source_size", "docs", F.least(cap * F.col("source_size").cast("double"), level * F.col("weight")).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column, cap: int) -> Column:
    e = F.exp(F.greatest(F.least(tilt * size / mean, F.lit(700.0)), F.lit(-700.0)))
    return cap * e / (cap - 1 + e)


def _with_state(cells: DataFrame, state: DataFrame, few: bool) -> DataFrame:
    named = state.withColumnRenamed("source", "_source")
    return cells.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def solve(cells: DataFrame, goals: DataFrame, few: bool, cap: int = CAP) -> DataFrame:
    """goals with ``tilt``: the dual variable of each source; null where every document gets the cap."""
    inf = float("inf")
    mean = F.greatest(F.col("source_size") / F.col("docs"), F.lit(1e-9))
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    first = F.when(full, F.lit(None)).otherwise(F.lit(0.0)).cast("double")
    state = goals.withColumns({"mean": mean, "tilt": first, "low": F.lit(-inf), "high": F.lit(inf), "off": F.when(full, 0.0).otherwise(1.0)}).checkpoint()
    for _ in range(ROUNDS):
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), cap)
        open_ones = state.where("off > 0").select("source", "mean", "tilt")
        sums = _with_state(cells, open_ones, few).groupBy("source").agg(
            F.sum(F.col("n") * F.col("size") * rate).alias("_got"),
            F.sum(F.col("n") * F.col("size") * F.col("size") / F.col("mean") * rate * (1 - rate / cap)).alias("_slope"),
        )
        named = sums.withColumnRenamed("source", "_source")
        joined = state.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        gap = F.col("_got") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("_slope")
        span = F.when(low == -inf, high - F.abs(high) - 1).when(high == inf, low + F.abs(low) + 1).otherwise((low + high) / 2)
        step = F.when((F.col("_slope") > 0) & (newton > low) & (newton < high) & (F.abs(newton - F.col("tilt")) <= 4 + F.abs(F.col("tilt"))), newton).otherwise(span)
        off = F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))
        off = F.when(off <= TOLERANCE, 0.0).otherwise(off)
        seen = F.col("_got").isNotNull()
        state = joined.select(
            "source", "source_size", "docs", "target", "mean",
            F.when(seen & (off > 0), step).otherwise(F.col("tilt")).alias("tilt"),
            F.when(seen, low).otherwise(F.col("low")).alias("low"),
            F.when(seen, high).otherwise(F.col("high")).alias("high"),
            F.when(seen, off).otherwise(F.lit(0.0)).alias("off"),
        ).checkpoint()
        if not (state.agg(F.max("off")).first()[0] or 0) > 0:
            break
    return state


def copies_of_cells(cells: DataFrame, solved: DataFrame, few: bool, cap: int = CAP, corrections: int = 4) -> DataFrame:
    """source, size, n, given: copies that a cell's n documents get together."""
    tilted = _with_state(cells, solved.select("source", "source_size", "target", "mean", "tilt"), few)
    rate = F.coalesce(_rate(F.col("tilt"), F.col("size"), F.col("mean"), cap), F.lit(float(cap)))
    by_size = Window.partitionBy("source").orderBy(F.col("size").desc())
    ideal = tilted.withColumn("_ideal", F.col("n") * rate)
    run = ideal.withColumn("_run", F.floor(F.sum("_ideal").over(by_size) + 0.5))
    given = F.col("_run") - F.coalesce(F.lag("_run").over(by_size), F.lit(0))
    out = run.withColumn("given", F.greatest(F.lit(0), F.least(given, cap * F.col("n"))).cast("long"))
    whole = Window.partitionBy("source")
    for _ in range(corrections):
        out = out.withColumn("_gap", F.col("target") - F.sum(F.col("given") * F.col("size")).over(whole))
        room = F.when(F.col("_gap") > 0, cap * F.col("n") - F.col("given")).otherwise(F.col("given"))
        fits = (F.col("size") > 0) & (F.col("size") <= F.abs("_gap"))
        out = out.withColumn("_room", F.when(fits, room).otherwise(0))
        larger = F.coalesce(F.sum(F.col("_room") * F.col("size")).over(by_size.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        change = F.least(F.floor(F.greatest(F.abs("_gap") - larger, F.lit(0.0)) / F.greatest("size", F.lit(1))), F.col("_room"))
        out = out.withColumn("given", (F.col("given") + F.signum("_gap") * change).cast("long"))
    return out.select("source", "size", "n", "given", "source_size", "target")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cap: int = CAP) -> DataFrame:
    """One row per document: key, size, source_size, target, copies (0 to ``cap``), taken = copies * size."""
    base = written(docs.select(F.col(key), F.col(source).alias("source"), words(F.col(text)).alias("size")), "sizes")
    cells = written(base.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "cells")
    goals = targets(cells, cap)
    goals = goals.checkpoint()  # written() above has set the checkpoint folder
    few = goals.count() <= SMALL_SOURCES
    plan = written(copies_of_cells(cells, solve(cells, goals, few, cap), few, cap), "copies").withColumnsRenamed({"source": "_source", "size": "_size"})
    joined = base.join(plan, F.col("source").eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")))
    every = F.floor(F.col("given") / F.col("n"))
    buckets = F.ceil(F.col("n") / BUCKET)
    dealt = joined.select(key, "source", "size", "n", "source_size", "target", F.xxhash64(key).alias("_hash"), every.alias("_every"), (F.col("given") - every * F.col("n")).alias("_more"), buckets.alias("_buckets"))
    dealt = dealt.withColumn("_bucket", F.pmod(F.xxhash64("_hash"), F.col("_buckets")))
    group = Window.partitionBy("source", "size", "_bucket")
    here = F.count(F.lit(1)).over(group)
    luck = F.pmod(F.xxhash64("source", "size", "_bucket"), F.lit(1_000_003)) / 1_000_003
    quota = F.when(F.col("_buckets") == 1, F.col("_more")).otherwise(F.floor(here * F.col("_more") / F.col("n") + luck))
    rank = F.row_number().over(group.orderBy("_hash", key))
    copies = (F.col("_every") + F.when(rank <= quota, 1).otherwise(0)).cast("long")
    return dealt.select(key, "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as its copies say (0 to 3 times)."""
    plan = mix(docs, key, text, source).select(F.col(key).alias("_key"), F.col("copies").alias("_copies"), F.col("size").alias("_size"))
    # repeated rows of one doc_id: their copies together go to the rows in equal parts, rounded by row
    per_key = plan.groupBy("_key", "_size").agg(F.sum("_copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    rows = docs.select(F.col(key).alias("_id"), words(F.col(text)).alias("_words"), F.struct(*docs.columns).alias("_row"))
    joined = rows.join(per_key, F.col("_id").eqNullSafe(F.col("_key")) & (F.col("_words") == F.col("_size")))
    share = F.least(F.lit(CAP), F.round(F.col("_copies") / F.col("_rows"))).cast("int")
    times = F.when(share > 0, F.sequence(F.lit(1), share)).otherwise(F.array().cast("array<int>"))
    return joined.select("_row", F.explode(times).alias("_copy")).select("_row.*")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of every document in a mix of all sources that weigh 1, 2, 3, repeating."""
    return mix(table(spark, sf_dir, "documents"))
