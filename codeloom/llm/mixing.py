"""Mixing sources to target weights by a time-varying curriculum.

Every source has a target: its weight's share of all words, at most ``repeats`` times its own size, the excess shared
anew by weight (the level is found in closed form from sources sorted by size over weight). A schedule says
how a source's share moves over training time 0 to 1, by knots with linear weights between them. Its integral, scaled
to the target, is the source's cumulative demand; the words that come before a document in its source, in hashed
order and epoch after epoch, are a value of that demand, and the inverse gives the document's position in time.
Documents range-sorted by position are the training order, and a running sum gives each its first word's place.

The last document that a source needs is cut at the target, so a source gives exactly the floor of it.

Cases: a null text has no words; a null source is a source of its own, last by code point; a null id hashes like any other value; rows that
repeat an id are documents of their own, those equal in id and text take any order among themselves; a source without words has target 0, and
none of its documents is taken; very long texts are counted whole; further columns are left out, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, running

#: Weights of the sources by rank, repeating.
WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Schedules by rank, repeating: (time, relative weight) knots. Sources of great weight fade, those of small weight grow.
SCHEDULES = (((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 1.0), (1.0, 2.0)))
SEED = 17


def source_sizes(sized: DataFrame) -> DataFrame:
    """(source, source_size) with ``place``, the source's rank by code point, null last. ``sized``: source, size."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    return running(sums.withColumn("_null", F.col("source").isNull()), ["_null", "source"], label="sources").drop("_null").withColumnRenamed("rank", "place")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """``sizes`` with ``target`` (double) and ``quota``, the whole words below it.

    A source stops at ``repeats`` times its size. Sorted by size over weight, those that stop come first: source k stops where its
    limit is at most its weight's share of what the sources before it leave. Sums are exact integers.
    """
    weight = F.element_at(F.array(*[F.lit(w).cast("decimal(19,0)") for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("limit", (F.col("source_size") * repeats).cast("decimal(19,0)"))
    s = s.withColumn("ratio", F.col("source_size").cast("double") / F.col("w").cast("double"))
    r = running(s, ["ratio", "place"], weight="limit", label="limits").withColumnRenamed("before", "limits_before").drop("rank")
    r = running(r, ["ratio", "place"], weight="w", label="weights").withColumnRenamed("before", "w_before").drop("rank")
    total = r.agg(F.sum("source_size"), F.sum("w").cast("long")).first()
    left, w_left = F.lit(total[0]) - F.col("limits_before"), F.lit(total[1]) - F.col("w_before")
    # products stay below 38 digits: sizes and sums of weights below 10^18
    big = "decimal(19,0)"
    r = r.withColumn("stops", F.col("limit") * w_left.cast(big) <= left.cast(big) * F.col("w"))
    free = r.agg(F.sum(F.when(F.col("stops"), F.col("limit")).otherwise(0)).cast("long"), F.sum(F.when(~F.col("stops"), F.col("w"))).cast("long")).first()
    r = r.withColumn("part", F.lit((total[0] or 0) - (free[0] or 0)).cast(big) * F.col("w")).withColumn("over", F.lit(free[1] or 1).cast(big))
    target = F.when(F.col("stops"), F.col("limit").cast("double")).otherwise(F.col("part").cast("double") / F.col("over").cast("double"))
    quota = F.when(F.col("stops"), F.col("limit").cast("long")).otherwise(F.expr("part div over"))
    return r.select("source", "place", "source_size", target.alias("target"), quota.alias("quota"))


def _pick(values: Sequence[Column], k: Column) -> Column:
    return F.element_at(F.array(*values), (k % len(values) + 1).cast("int"))


def when_demanded(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the schedule's integral comes to ``share`` (0 to 1) of its whole.

    Between knots the weight is linear, so the integral is quadratic; the root is taken in the form that stays exact where the slope is small.
    """
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    if min(b[0] - a[0] for a, b in zip(knots, knots[1:])) <= 0 or min(w for _, w in knots) < 0 or sum(areas) <= 0:
        raise ValueError("a schedule needs rising times, weights of at least 0 and some weight")
    need, out, before = share * F.lit(sum(areas)), None, sum(areas)
    for (t0, w0), (t1, w1), area in reversed([*zip(knots, knots[1:], areas)]):
        before -= area
        slope, rest = (w1 - w0) / (t1 - t0), F.greatest(need - F.lit(before), F.lit(0.0))
        root = F.lit(w0) + F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * slope) * rest, F.lit(0.0)))
        time = F.least(F.lit(t0) + F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0)), F.lit(t1))
        out = time if out is None else F.when(need <= F.lit(before + area), time).otherwise(out)
    return out


def curriculum(df: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
               id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each epoch that takes a document: the training order.

    Columns: doc_id, size, source_size, target, source_place, source_rank (which together name the row of ``df``), epoch, n_words (taken in the
    epoch), position (training time, 0 to 1) and start (words of the training order before it), range-sorted by position. A document that is
    not taken has one row with epoch 0, no words and null position and start.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    slim = cut(df.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), F.md5(F.concat_ws(":", F.lit(SEED), F.col(id_col).cast("string"))).alias("_h"),
        F.md5(F.col(text_col)).alias("_t")), "sizes")
    wanted = targets(source_sizes(slim), weights, repeats)
    ranked = running(slim, ["_h", "doc_id", "_t", "size"], ["source"], weight="size", label="mix").withColumnRenamed("source", "_source")
    rows = ranked.join(F.broadcast(wanted) if _few(wanted) else wanted, F.col("_source").eqNullSafe(F.col("source")))
    # epoch e takes words [e * source_size + before, ... + size) of the source's endless order, up to the quota
    at = F.col("e") * F.col("source_size") + F.col("before")
    given = F.least(F.col("size"), F.greatest(F.col("quota") - at, F.lit(0)))
    copies = rows.withColumn("e", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("n_words", given).filter((F.col("n_words") > 0) | (F.col("e") == 0))
    share = (at + F.col("n_words") / 2) / F.col("quota")
    time = _pick([when_demanded(share, s) for s in schedules], F.col("place"))
    copies = copies.select("doc_id", "size", "source_size", "target", F.col("place").alias("source_place"), F.col("rank").alias("source_rank"),
        F.col("e").cast("int").alias("epoch"), "n_words", F.when(F.col("n_words") > 0, time).alias("position"))
    placed = running(copies, ["position", "source_place", "epoch", "source_rank"], weight="n_words", label="order")
    return placed.withColumn("start", F.when(F.col("n_words") > 0, F.col("before"))).drop("before", "rank")


def _few(wanted: DataFrame, most: int = 100_000) -> bool:
    """Whether the sources, counted, are few enough to be sent to every task."""
    return wanted.limit(most + 1).count() <= most


def mix(df: DataFrame) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and the first and last positions it is trained at."""
    order = curriculum(df)
    return order.groupBy("source_place", "source_rank").agg(F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("source_size").alias("source_size"),
        F.first("target").alias("target"), F.sum("n_words").alias("taken"), F.min("start").alias("first_start"), F.min("position").alias("first_position"),
        F.max("position").alias("last_position")).drop("source_place", "source_rank")
