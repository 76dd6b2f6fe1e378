"""Top-1-per-group rules and total orders. Null order follows the reference stores: nulls are largest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import edition_rank, version_key
from .lineage import Growing, cut, shuffled, sized


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group. Every order ends in a key, so the pick is determined."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def declaring_order() -> list[Column]:
    """Five tiers: definition first, more fields, more dependents, edition, module name."""
    return [F.col("is_definition").desc_nulls_last(), F.col("field_count").desc_nulls_last(), F.col("dependents").desc_nulls_last(),
        edition_rank(F.col("edition")).asc(), F.col("module").asc_nulls_last()]


def declaring_module(df: DataFrame, keys: list[str]) -> DataFrame:
    return first_by(df, keys, declaring_order())


def parent_order() -> list[Column]:
    """How one parent is chosen among modules that declare it."""
    return [F.col("is_definition").desc_nulls_last(), F.col("field_count").desc_nulls_last(), F.col("module").asc_nulls_last()]


def met_rows(tags: DataFrame, members: DataFrame) -> int:
    """How many rows ``tags`` (name) joined with ``members`` (model) gives."""
    a = tags.groupBy("name").agg(F.count(F.lit(1)).alias("_a"))
    b = members.groupBy(F.col("model").alias("name")).agg(F.count(F.lit(1)).alias("_b"))
    return a.join(shuffled(b), "name").agg(F.sum(F.col("_a") * F.col("_b"))).first()[0] or 0


def inherited_members(tags: DataFrame, members: DataFrame, module: str | None = None, few: bool = False) -> DataFrame:
    """Each start's members, own and inherited, from the nearest owner.

    ``tags`` comes from ``graph.ancestors``; ``members`` has (model, name, module, edition, ttype), repeats are harmless. As in the reference, a
    module filter applies before the nearest owner is picked, so a farther owner can win. Both are written and what their join gives is counted, so
    that tasks are as many as its rows need; a request for ``few`` starts goes without.
    """
    rows = members if module is None else members.filter(F.col("module") == module)
    rest = [c for c in rows.columns if c not in ("model", "name", "module")]
    # of a model's rows of one name only the first can be picked, whatever the start
    own = ["_e", "_none", "module", *rest]
    first = F.min(F.struct(edition_rank(F.col("edition")).alias("_e"), F.col("module").isNull().alias("_none"), "module", *rest)).alias("b")
    if not few:
        rows = sized(rows, rows.count(), "model", "name")
    rows = rows.groupBy("model", "name").agg(first).select("model", "name", *[F.col(f"b.{c}").alias(c) for c in own])
    tags, told = tags.select("start", "name", "depth"), [c for c in members.columns if c not in ("model", "name")]
    if few:
        met = tags.withColumnRenamed("name", "owner").join(rows.withColumnRenamed("model", "owner"), "owner")
        best = met.groupBy("start", "name").agg(F.min(F.struct("depth", "_e", "_none", "module", "owner", *rest)).alias("b"))
        return best.select("start", "name", *[F.col(f"b.{c}").alias(c) for c in ("owner", "depth", *told)])
    tags, rows = cut(tags), cut(rows)
    n = met_rows(tags, rows)
    book, packed = _packed(rows, ["name", *own])
    met = sized(tags.withColumnRenamed("name", "owner"), n, "owner").join(shuffled(sized(packed.withColumnRenamed("model", "owner"), n, "owner")), "owner")
    met = sized(met, n, "start").select("start", "depth", "owner", F.inline(F.arrays_zip("_c", "_h", "_f")))
    # numbers of one name and of one module's rows of it are consecutive
    name, head = (F.col("_c").cast("long") - F.col("_f")).alias("_name"), (F.col("_c").cast("long") - F.col("_h")).alias("_head")
    best = met.groupBy("start", name).agg(F.min(F.struct("depth", head, "owner", "_c")).alias("b")).select("start", "b.owner", "b.depth", "b._c")
    return best.join(book, "_c").select("start", "name", "owner", "depth", *told)


def _packed(rows: DataFrame, words: list[str]) -> tuple[DataFrame, DataFrame]:
    """Different ``words`` of ``rows``, whose last but ``rest`` are name, edition's rank, whether there is no module, and module, numbered in their order (``_c``);
    and for each model the numbers of its rows, with how far each is from the first of its name (``_f``) and of its name and module (``_h``).

    So a member travels as a few bytes instead of its words, in number types that are as short as the greatest number allows.
    """
    book, at = placed(rows.select(*words).distinct(), words), F.col("place")
    first = lambda *by: at - F.min("place").over(Window.partitionBy(*by))
    book = cut(book.select(*words, at.alias("_c"), first(words[0]).alias("_f"), first(*words[:4]).alias("_h")))
    most = book.agg(*[F.max(c).alias(c) for c in ("_c", "_f", "_h")]).first()
    short = {c: next(t for t, top in (("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31), ("bigint", 2**63)) if (most[c] or 0) < top) for c in ("_c", "_f", "_h")}
    book = book.select(*words, *[F.col(c).cast(t).alias(c) for c, t in short.items()])
    same = [F.col(f"r.{w}").eqNullSafe(F.col(f"b.{w}")) for w in words]
    coded = rows.alias("r").join(book.alias("b"), same).select("r.model", *[f"b.{c}" for c in short])
    packed = sized(coded, rows.count(), "model").groupBy("model").agg(F.sort_array(F.collect_list(F.struct(*short))).alias("m"))
    return book.drop("_f", "_h"), packed.select("model", *[F.col(f"m.{c}").alias(c) for c in short])


def count_members(tags: DataFrame, members: DataFrame) -> DataFrame:
    """(start, n): how many names the members of a start and its ancestors have; a start without any has no row."""
    names = sized(members.select(F.col("model").alias("name"), F.col("name").alias("member")), members.count(), "name", "member").distinct()
    tags, names = cut(tags.select("start", "name")), cut(names)
    n = met_rows(tags, names.withColumnRenamed("name", "model"))
    met = sized(tags, n, "name").join(shuffled(sized(names, n, "name")), "name").select("start", "member")
    return sized(met, n, "start", "member").distinct().groupBy("start").agg(F.count("member").alias("n"))


def field_lookup(wanted: DataFrame, tags: DataFrame, members: DataFrame, magic: DataFrame) -> DataFrame:
    """Find fields in three steps: declared on the model (least module), magic, else nearest ancestor.

    ``wanted`` has (start, field). The result says by ``step`` (direct, magic, inherited) where each was found; fields
    found nowhere have a null step.
    """
    have = tags.select("start", F.col("name").alias("owner"), "depth").join(shuffled(members.select(F.col("model").alias("owner"),
        F.col("name").alias("field"), "module", "ttype")), "owner")
    found = wanted.join(shuffled(have), ["start", "field"]).select("start", "field", F.when(F.col("depth") == 0, 0).otherwise(2).alias("prio"), "depth",
        "owner", "module", "ttype")
    fixed = wanted.join(magic.select(F.col("name").alias("field"), "ttype"), "field").select("start", "field", F.lit(1).alias("prio"),
        F.lit(0).alias("depth"), F.col("start").alias("owner"), F.lit(None).cast("string").alias("module"), "ttype")
    best = first_by(found.unionByName(fixed), ["start", "field"], [F.col("prio"), F.col("depth"),
        F.when(F.col("prio") == 0, F.lit(None)).otherwise(F.col("owner")).asc_nulls_first(), F.col("module").asc_nulls_last()])
    step = F.when(F.col("prio") == 0, "direct").when(F.col("prio") == 1, "magic").when(F.col("prio") == 2, "inherited")
    return wanted.join(shuffled(best), ["start", "field"], "left").select("start", "field", step.alias("step"), "depth", "owner", "module", "ttype")


def nearest_fields(wanted: DataFrame, edges: DataFrame, members: DataFrame, magic: DataFrame, kinds: Sequence[str]) -> DataFrame:
    """``field_lookup`` among all ancestors, however far up they are.

    ``edges`` has (src, dst, kind), ``members`` repeats are harmless. The fields that are still wanted walk up hop by hop, from the names that the last hop met: a field
    leaves the walk where it is found, one that no model declares never enters it, so few are left after the first hops. Each hop is written; as in
    ``graph.closure`` names are compared with those met before once they have doubled, so cycles end.
    """
    pair = ["start", "field"]
    step = cut(edges.filter(F.col("kind").isin(*kinds) & (F.col("src") != F.col("dst"))).select("src", "dst").distinct())
    asked = cut(wanted.select(*pair).distinct())
    names = cut(asked.select("field").distinct())
    have = members.select(F.col("model").alias("name"), F.col("name").alias("field"), "module", "ttype").join(names, "field", "left_semi")
    have = cut(have.groupBy("name", "field").agg(F.min(F.struct(F.col("module").isNull().alias("none"), "module", "ttype")).alias("hit")))

    def met(front: DataFrame, depth: int) -> DataFrame:
        return front.join(shuffled(have), ["name", "field"], "left").select(*pair, "name", F.lit(depth).alias("depth"), "hit")

    def beyond(front: DataFrame) -> DataFrame:
        left = front.filter("hit is null").join(shuffled(front.filter("hit is not null").select(*pair)), pair, "left_anti")
        return left.join(shuffled(step), F.col("name") == F.col("src")).select(*pair, F.col("dst").alias("name")).distinct()

    found, depth = Growing(met(asked.withColumn("name", F.col("start")), 0)), 0
    fixed = magic.select(F.col("name").alias("field"), F.col("ttype").alias("_fixed"))
    front = found.last().join(fixed, "field", "left_anti").join(cut(have.select("field").distinct()), "field", "left_semi")
    while True:
        size, walk, walked, n = found.all().count(), None, 0, 1
        while n and (walk is None or walked < size):
            depth += 1
            near = met(beyond(front), depth)
            if walk is None:
                walk = Growing(near)
            else:
                walk.add(near)
            front = walk.last()
            n = front.count()
            walked += n
        if not n:
            break
        fresh = walk.all().groupBy(*pair, "name").agg(F.min(F.struct("depth", "hit")).alias("b")).select(*pair, "name", "b.depth", "b.hit")
        if not found.add(fresh.join(shuffled(found.all().select(*pair, "name")), [*pair, "name"], "left_anti")):
            break
        front = found.last().filter(F.col("depth") == depth)
    hits = found.all().union(walk.all()).filter("hit is not null")
    best = hits.groupBy(*pair).agg(F.min(F.struct("depth", F.col("name").alias("owner"), F.col("hit.none"), F.col("hit.module"), F.col("hit.ttype"))).alias("b"))
    rows = wanted.join(shuffled(best), pair, "left").join(fixed, "field", "left")
    # a built-in field doesn't walk, so it was found on the model itself or not at all
    magical = F.col("b").isNull() & F.col("_fixed").isNotNull()
    step_name = F.when(magical, "magic").when(F.col("b.depth") == 0, "direct").when(F.col("b").isNotNull(), "inherited")
    return rows.select(*pair, step_name.alias("step"), F.when(magical, 0).otherwise(F.col("b.depth")).alias("depth"), F.when(magical, F.col("start")).otherwise(F.col("b.owner")).alias("owner"),
        F.col("b.module").alias("module"), F.when(magical, F.col("_fixed")).otherwise(F.col("b.ttype")).alias("ttype"))


def via_rank(via: Column) -> Column:
    """How directly a test covers something: by an assertion, in its body, or otherwise."""
    return F.when(via == "assert", 0).when(via == "body", 1).otherwise(2)


def tests_first(df: DataFrame, via: str, asserts: str, ties: Sequence[str], limit: int) -> DataFrame:
    """Tests that assert first, then those with more assertions, then ``ties``; cut to ``limit``."""
    return df.orderBy(via_rank(F.col(via)), F.col(asserts).desc_nulls_last(), *ties).limit(limit)


def placed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``place`` (from 0) in a total order: range-sorted and written, then counted by partition, so no task holds all rows."""
    part = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at",
        F.monotonically_increasing_id()))
    # one row a partition
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("_at")) - 1
    return part.withColumn("_in", inside).join(before, F.col("_part") == F.col("_p")).withColumn("place",
        (F.col("_in") + F.col("_before")).cast("long")).drop("_part", "_at", "_in", "_p", "_before")


def newest_versions(df: DataFrame, version: str = "version") -> DataFrame:
    """``df`` with ``place`` from 0: versions ``N.M`` by their numbers, newest first, then names of another shape."""
    key = version_key(F.col(version))
    keyed = df.withColumn("_other", key.isNull()).withColumn("_major", -key["major"]).withColumn("_minor", -key["minor"])
    return placed(keyed, ["_other", "_major", "_minor", version]).drop("_other", "_major", "_minor")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def with_total(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page with the number of all rows beside it, counted by its own aggregate, not a window over all."""
    return page(df, order, offset, limit).withColumn("total", df.agg(F.count(F.lit(1))).scalar())


def probe(df: DataFrame, order: list[Column], cap: int) -> DataFrame:
    """At most ``cap`` rows and one more, so that a caller sees the overflow."""
    return df.orderBy(*order).limit(cap + 1)
