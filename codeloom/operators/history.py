"""Incremental ingest from commit and tree tables: which repositories to skip, to scan in part, or to scan whole, and which modules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import shuffled
from .ordering import reach

#: Files that make a folder a module.
MANIFESTS = ("__manifest__.py", "__openerp__.py")


def is_ancestor(pairs: DataFrame, commits: DataFrame) -> DataFrame:
    """``pairs`` (repo, old, new) with ``ancestor``: whether ``old`` is ``new`` or can be reached from it by parents.

    ``commits``: repo, sha, parents. Each head's history is walked by doubling, so a line of 1,000 commits takes about ten rounds. A commit
    that isn't in the table is nobody's ancestor but its own.
    """
    node = lambda c: F.struct("repo", F.col(c).alias("sha"))
    links = commits.select("repo", "sha", F.explode("parents").alias("parent")).select(node("sha").alias("src"), node("parent").alias("dst"))
    known = commits.select("repo", F.col("sha").alias("old")).distinct().withColumn("_known", F.lit(True))
    found = reach(pairs.select(node("new").alias("start")).distinct(), links).select(F.col("start.repo").alias("repo"), F.col("start.sha").alias("new"),
        F.col("name.sha").alias("old"), F.lit(True).alias("_hit"))
    out = pairs.join(shuffled(found), ["repo", "old", "new"], "left").join(shuffled(known), ["repo", "old"], "left")
    return out.select(*pairs.columns, F.coalesce(F.col("_hit") & (F.col("_known") | (F.col("old") == F.col("new"))), F.lit(False)).alias("ancestor"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(repo, path) of files that are added, removed or changed between two trees (repo, path, blob).

    Top folders are compared first, by a hash of what is in them that is summed before the shuffle; only files of folders that differ are
    shuffled and compared.
    """
    both = old.select("repo", "path", "blob", F.lit(-1).alias("side")).unionByName(new.select("repo", "path", "blob", F.lit(1).alias("side")))
    both = both.withColumn("_top", F.substring_index("path", "/", 2))
    # two sums of independent hashes: equal trees cancel out, whatever the order of their files
    one, two = (F.sum(F.col("side") * F.xxhash64(F.lit(seed), "path", "blob").cast("decimal(38,0)")) for seed in (1, 2))
    differ = both.groupBy("repo", "_top").agg(one.alias("a"), two.alias("b")).filter("a <> 0 or b <> 0").select("repo", "_top")
    files = both.join(shuffled(differ), ["repo", "_top"], "left_semi").groupBy("repo", "path").agg(F.sum("side").alias("s"), F.count_distinct("blob").alias("blobs"))
    return files.filter("s <> 0 or blobs > 1").select("repo", "path")


def modules_of(paths: DataFrame, tree: DataFrame) -> DataFrame:
    """(repo, module) of each path: its nearest folder with a manifest in ``tree``; paths under no module give none. The repository's own folder is no module."""
    parts = F.split("path", "/")
    tops = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("folder")))
    above = paths.filter(F.size(parts) > 1).select("repo", "path", F.explode(tops).alias("t")).select("repo", "path", "t.*")
    have = tree.filter(F.substring_index("path", "/", -1).isin(*MANIFESTS) & F.col("path").contains("/"))
    have = have.select("repo", F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct()
    near = above.join(shuffled(have), ["repo", "folder"]).groupBy("repo", "path").agg(F.max(F.struct("depth", "folder"))["folder"].alias("module"))
    return near.select("repo", "module").distinct()


def ingest_plan(heads: DataFrame, commits: DataFrame, old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to do with each repository, and (repo, module, mode) of the modules to scan.

    ``heads``: repo, old (null: never scanned), new. Mode: skip where the head is the same, incremental where the old head is an ancestor of the new one, else
    full (a first scan, or a rewritten history). ``old`` and ``new`` are the trees (repo, path, blob) at these heads.
    """
    judged = is_ancestor(heads, commits)
    mode = F.when(F.col("old") == F.col("new"), "skip").when(F.col("ancestor"), "incremental").otherwise("full")
    modes = judged.select("repo", mode.alias("mode"))
    of = lambda tree, m: tree.join(modes.filter(F.col("mode") == m).select("repo"), "repo", "left_semi")
    some = modules_of(changed_files(of(old, "incremental"), of(new, "incremental")), of(new, "incremental")).withColumn("mode", F.lit("incremental"))
    whole = of(new, "full")
    manifests = whole.filter(F.substring_index("path", "/", -1).isin(*MANIFESTS))
    return modes, some.unionByName(modules_of(manifests, whole).withColumn("mode", F.lit("full")))
