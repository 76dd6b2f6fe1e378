"""Orders and chains of dependency graphs, as data.

``kahn_order`` gives the queue order of Kahn's algorithm without a queue: a name's place follows from its wave, the
place of the last dependency that it waited for, and its name. ``reach`` walks links by doubling, so a chain of
1,000 takes about ten rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import Growing, cut, shuffled
from .ranking import placed


def kahn_order(edges: DataFrame, names: DataFrame) -> DataFrame:
    """(name, place, wave): dependencies first, ``edges`` (src depends on dst) among ``names`` alone; names in or above a cycle last, by name, with null wave.

    A queue seeded and fed in name order gives out wave after wave. Within a wave a name comes when the last of its dependencies was
    given out, and those freed by one dependency come by name: so the order is (wave, place of the last dependency, name).
    Each wave is range-sorted; no task holds a wave.
    """
    all_names = cut(names.select("name").distinct())
    step = edges.select("src", "dst").distinct().join(all_names.withColumnRenamed("name", "dst"), "dst", "left_semi")
    step = cut(step.join(all_names.withColumnRenamed("name", "src"), "src", "left_semi"))
    seeds = all_names.join(step.select(F.col("src").alias("name")).distinct(), "name", "left_anti")
    seeds = placed(seeds, ["name"]).select("name", "place", F.lit(0).alias("wave"))
    done, wave, at = Growing(seeds), 0, 0
    at = done.last().count()
    while True:
        wave += 1
        last = done.last().select(F.col("name").alias("dst"), "place")
        freed = step.join(last, "dst").groupBy(F.col("src").alias("name")).agg(F.max("place").alias("_after"))
        step = cut(step.join(last, "dst", "left_anti"))
        ready = freed.join(step.select(F.col("src").alias("name")).distinct(), "name", "left_anti")
        ranked = placed(ready, ["_after", "name"]).select("name", (F.col("place") + at).alias("place"), F.lit(wave).alias("wave"))
        if not done.add(ranked):
            break
        at += done.last().count()
    rest = all_names.join(done.all().select("name"), "name", "left_anti")
    tail = placed(rest, ["name"]).select("name", (F.col("place") + at).alias("place"), F.lit(None).cast("int").alias("wave"))
    return done.all().unionByName(tail)


def reach(starts: DataFrame, links: DataFrame) -> DataFrame:
    """(start, name, depth): all names that each start reaches along ``links`` (src, dst), at the least depth; the start has depth 0.

    Round k knows all names nearer than 2^k and the links of exactly 2^k steps. A step over such a link from all that is known gives
    what is nearer than 2^(k+1). It ends when a round adds nothing: then no farther name is new either, so cycles end too.
    """
    jump = cut(links.select("src", "dst").filter("src is not null and dst is not null").distinct())
    found, length = Growing(starts.select("start", F.col("start").alias("name"), F.lit(0).alias("depth")).distinct()), 1
    while True:
        far = found.all().join(shuffled(jump), F.col("name") == F.col("src")).groupBy("start", F.col("dst").alias("name")).agg(F.min(F.col("depth") + length).alias("depth"))
        if not found.add(far.join(shuffled(found.all().select("start", "name")), ["start", "name"], "left_anti").select("start", "name", "depth")):
            return found.all()
        b = jump.withColumnsRenamed({"src": "_mid", "dst": "_end"})
        jump = cut(jump.join(shuffled(b), F.col("dst") == F.col("_mid")).select("src", F.col("_end").alias("dst")).distinct())
        length *= 2
