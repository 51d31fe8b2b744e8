"""Mixing sources to target sizes by entropy balancing.

Each source gets a target number of words. Document rates ``r`` minimise the relative entropy to the
plain corpus, ``sum(r log r - r + 1)``, so that every source's ``sum(r * size)`` meets its target and no
rate exceeds ``most``. The solution is the exponential tilt ``r = min(most, exp(lambda * size))`` with one
multiplier per source, found by Newton steps on the convex dual. Rates depend on source and size only,
so every step is an aggregate over the counts of (source, size), made once from all rows. Rates are
then rounded into whole copies, from long to short documents, each passing its rounding error on.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidings.llm.common import named, stored

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix as a share of all words.
TOTAL = 1.5
#: Most copies of a document, and of a source.
MOST = 2
STEPS = 80
#: A source is balanced when its dual gradient is this share of its size.
CLOSE = 1e-9
#: Bits of a hash that part the documents of one source and size into ranges.
RANGE_BITS = 12


def word_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Iterable[float] = WEIGHTS, total: float = TOTAL, most: float = MOST
) -> DataFrame:
    """``target`` added to the sources' rows (source, source_size and others).

    Sources in code-point order, null last, take the weights in turn and share ``total`` times all
    sizes in proportion; none gets more than ``most`` times its size, and what is over is shared anew.
    Sources are few (one row each), so their order is taken in one task.
    """
    weights = [float(w) for w in weights]
    everything = Window.orderBy("ratio", "at").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("at", place).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", most * F.col("source_size").cast("double"))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    nothing = F.lit(0.0)
    left = total * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(everything), nothing)
    open_ = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(everything), nothing)
    # Sources in rising order of cap per weight: the first that stays under its cap sets the level.
    ranked = ranked.withColumn("level", left / open_).withColumn("under", left <= F.col("ratio") * open_)
    first = F.min(F.when(F.col("under"), F.struct("ratio", "at", "level"))).over(whole)
    level = F.greatest(F.coalesce(first["level"], F.lit(math.inf)), nothing)
    ranked = ranked.withColumn("share", level * F.col("weight"))
    target = F.least("cap", "share")
    return ranked.select(*sizes.columns, target.alias("target"))


def _multipliers(spark: SparkSession, of: dict[int, float]) -> DataFrame:
    """One row per source. Rows that come in Arrow need no Python workers on the executors, as lists of rows do."""
    columns = {"k": pa.array(list(of), pa.int32()), "multiplier": pa.array(list(of.values()), pa.float64())}
    return spark.createDataFrame(pa.table(columns))


def solve_multipliers(cells: DataFrame, targets: list, most: float = MOST, steps: int = STEPS) -> list[float]:
    """The multiplier of every source (numbered 0, 1, ...) by Newton steps on the dual.

    ``cells`` (k, size, n) stay distributed: a step sums gradient and curvature over them and brings one
    row per source to the driver. Steps that leave the bracket of the root are replaced by halving it.
    """
    spark = cells.sparkSession
    top = math.log(most)
    # At ``top`` every document that has words is at its bound; far below, nothing is taken.
    low, high = [-math.inf] * len(targets), [top] * len(targets)
    reach = [1 / max(t["mean"], 1.0) for t in targets]
    now = [
        min(top, math.log(max(t["target"] / t["source_size"], 1e-9)) * w) if t["source_size"] else 0.0
        for t, w in zip(targets, reach, strict=True)
    ]
    todo = {k for k, t in enumerate(targets) if t["source_size"]}
    for _ in range(steps):
        if not todo:
            break
        given = _multipliers(spark, {k: now[k] for k in sorted(todo)})
        rate = F.exp(F.least(F.col("multiplier") * F.col("size"), F.lit(top)))
        words = F.col("n") * F.col("size") * rate
        bent = F.when(F.col("multiplier") * F.col("size") < top, words * F.col("size")).otherwise(0.0)
        sums = cells.join(given, "k").groupBy("k").agg(F.sum(words).alias("words"), F.sum(bent).alias("bent"))
        for row in sums.collect():
            k, target = row["k"], targets[row["k"]]["target"]
            gradient = row["words"] - target
            if abs(gradient) <= CLOSE * targets[k]["source_size"]:
                todo.discard(k)
                continue
            if gradient > 0:
                high[k] = now[k]
            else:
                low[k] = now[k]
            newton = now[k] - gradient / row["bent"] if row["bent"] > 0 else math.nan
            if low[k] < newton < high[k]:
                now[k] = newton
            elif low[k] > -math.inf:
                now[k] = (low[k] + high[k]) / 2
            else:
                now[k] -= reach[k]
                reach[k] *= 2
    return now


def whole_copies(cells: pd.DataFrame, most: int = MOST) -> pd.DataFrame:
    """Copies for all documents of each size of one source, passing rounding errors from long to short."""
    cells = cells.sort_values("size", ascending=False)
    owed, out = 0.0, []
    for n, size, rate in zip(cells["n"], cells["size"], cells["rate"], strict=True):
        owed += n * size * rate
        copies = min(max(round(owed / size), 0), most * n) if size else n
        owed -= copies * size
        out.append(copies)
    return cells.assign(copies=out)


def _rounded(most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return whole_copies(pdf, most)[["k", "size", "n", "copies"]]

    return run


def mix(
    docs: DataFrame,
    weights: Iterable[float] = WEIGHTS,
    total: float = TOTAL,
    most: int = MOST,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    rows_too: bool = False,
) -> DataFrame:
    """Size, target and copies of every row, with ``taken = size * copies``.

    Only slim rows (id, source, size, hash) are shuffled; ``rows_too`` adds the whole row as ``row``. Null
    texts have size 0, as have wordless ones; they stay once and add nothing. Null sources are a source
    of their own. Which rows of one source and size get an extra copy depends on a hash of id and
    text alone, so reruns agree; of rows equal in both, as many as are owed one get it, whichever they
    are. An empty table gives an empty result.
    """
    source = named(source_col)
    rows = docs.select(
        named(id_col).alias("id"),
        F.struct(source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")).alias("s"),
        word_count(named(text_col)).alias("size"),
        F.xxhash64(named(id_col), named(text_col)).alias("h"),
        *([F.struct(*map(named, docs.columns)).alias("row")] if rows_too else []),
    )
    cells = stored(rows.groupBy("s", "size").agg(F.count("*").alias("n")), "cells")
    words = F.sum(F.col("n") * F.col("size"))
    sizes = cells.groupBy("s").agg(words.alias("source_size"), (words / F.sum("n")).alias("mean"))
    sources = sizes.select(F.when(~F.col("s.none"), F.col("s.name")).alias("source"), "source_size", "mean")
    wanted = source_targets(sources, weights, total, most)
    # One row per source: the parameters of the mix.
    targets = sorted((r.asDict() for r in wanted.collect()), key=lambda r: (r["source"] is None, r["source"] or ""))
    spark = docs.sparkSession
    names = pa.table(
        {
            "k": pa.array(range(len(targets)), pa.int32()),
            "none": pa.array([t["source"] is None for t in targets], pa.bool_()),
            "name": pa.array([t["source"] or "" for t in targets], pa.string()),
            "source_size": pa.array([t["source_size"] for t in targets], pa.int64()),
            "target": pa.array([t["target"] for t in targets], pa.float64()),
        }
    )
    numbered = spark.createDataFrame(names).select("k", F.struct("none", "name").alias("s"), "source_size", "target")
    counted = stored(cells.join(numbered.select("k", "s"), "s").select("k", "size", "n"), "counted")
    found = solve_multipliers(counted, targets, most)
    multipliers = _multipliers(spark, dict(enumerate(found)))
    rated = counted.join(multipliers, "k").withColumn(
        "rate", F.exp(F.least(F.col("multiplier") * F.col("size"), F.lit(math.log(most))))
    )
    # A source has at most as many rows here as it has document sizes.
    rounded = rated.groupBy("k").applyInPandas(_rounded(most), "k int, size bigint, n bigint, copies bigint")
    rounded = stored(rounded.join(numbered, "k").select("s", "size", "n", "copies", "source_size", "target"), "copies")

    # Of n documents in a cell, ``copies % n`` get one more: those with the lowest hashes. The last of
    # them is found in one range of the hash, by counting up to that range and then inside it.
    cell = ["s", "size"]
    slim = rows.select("s", "size", "h", F.shiftright("h", 64 - RANGE_BITS).alias("range"))
    before = Window.partitionBy(*cell).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = slim.groupBy(*cell, "range").agg(F.count("*").alias("m"))
    counts = counts.withColumn("first", F.coalesce(F.sum("m").over(before), F.lit(0)))
    more = counts.join(rounded.select(*cell, (F.col("copies") % F.col("n")).alias("extra")), cell)
    last = more.where("first < extra AND extra <= first + m")
    last = last.select(*cell, "range", (F.col("extra") - F.col("first")).alias("at"))
    hashes = slim.join(last, [*cell, "range"]).groupBy(*cell, "range", "h").agg(
        F.count("*").alias("same"), F.min("at").alias("at")
    )
    lower = Window.partitionBy(*cell, "range").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    hashes = hashes.withColumn("owed", F.col("at") - F.coalesce(F.sum("same").over(lower), F.lit(0)))
    cuts = hashes.where("0 < owed AND owed <= same").select(*cell, F.col("h").alias("cut"), "owed", "same")
    plan = stored(rounded.join(cuts, cell, "left").withColumn("base", F.floor(F.col("copies") / F.col("n"))), "plan")

    tie = F.coalesce((F.col("h") == F.col("cut")) & (F.col("owed") < F.col("same")), F.lit(False))
    more = F.when(F.col("h") <= F.col("cut"), 1).otherwise(0)
    out = rows.join(plan, cell).where(~tie).withColumn("c", (F.col("base") + more).cast("bigint"))
    kept = ["id", "size", "source_size", "target", "c", *(["row"] if rows_too else [])]
    out = out.select(*kept)
    ties = plan.where("owed < same").withColumn("h", F.col("cut"))
    if not ties.isEmpty():
        out = out.union(_dealt(rows, ties).select(*kept))
    return out.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("c")).alias("taken"),
        F.col("c").alias("copies"),
        *(["row"] if rows_too else []),
    )


def _dealt(rows: DataFrame, ties: DataFrame) -> DataFrame:
    """The rows whose hash is the last of a cell, ``owed`` of which get one copy more than ``base``.

    Rows are numbered where they are read and then stored, so that their numbers stay; a group, which may
    hold any share of all rows, is counted by read tasks and ranked inside each of them.
    """
    numbered = rows.withColumn("at", F.monotonically_increasing_id())
    tied = stored(numbered.join(ties, ["s", "size", "h"]).withColumn("task", F.shiftright("at", 33)), "ties")
    key = ["s", "size", "h"]
    before = Window.partitionBy(*key).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = tied.groupBy(*key, "task").agg(F.count("*").alias("m"))
    first = first.select(*key, "task", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    place = F.row_number().over(Window.partitionBy(*key, "task").orderBy("at")) + F.col("first")
    more = F.when(place <= F.col("owed"), 1).otherwise(0)
    return tied.join(first, [*key, "task"]).withColumn("c", (F.col("base") + more).cast("bigint"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mix: every row as often as its copies say, with the columns of ``docs``."""
    taken = mix(docs, rows_too=True, **options)
    again = F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))
    return taken.select("row", again.alias("copy")).select("row.*")
