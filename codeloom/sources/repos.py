"""Repositories and module manifests: text tables to module rows."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence
from fnmatch import fnmatch
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.control import manifest_version

#: What to do with a module under each licence; others are served.
LICENSE_POLICY = {"LGPL-3": "serve", "AGPL-3": "serve", "GPL-3": "serve", "OPL-1": "serve", "unknown": "serve", "OEEL-1": "skip"}
MANIFESTS = ("__manifest__.py", "__openerp__.py")

MODULE = "path string, name string, shortdesc string, version_raw string, license string, author string, category string, depends array<string>, auto_install boolean, application boolean, installable boolean, readable boolean, assets map<string,string>"


def list_files(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths below ``root`` whose name fits a shell pattern. Spark's readers hide names that begin with ``_``, as manifests' do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        f = found.next().getPath()
        if fnmatch(f.getName(), pattern):
            out.append(f.toString())
    return sorted(out)


def read_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content) of the files below ``root`` whose name fits. The driver lists names, tasks read contents."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in batches:
            for path in b["path"]:
                store, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if re.match("file:/[^/]", path) else path)
                with store.open_input_file(at) as f:
                    yield pd.DataFrame({"path": [path], "content": [f.read().decode("utf-8", "replace")]})

    paths = [(p,) for p in list_files(spark, root, pattern)]
    listed = spark.createDataFrame(paths, "path string")
    return (listed.repartition(max(1, len(paths) // 256)) if paths else listed).mapInPandas(read, "path string, content string")


def find_manifests(spark: SparkSession, root: str) -> DataFrame:
    """Manifests of either name; where a folder has both, the modern one counts."""
    both = [read_files(spark, root, name).withColumn("rank", F.lit(i)) for i, name in enumerate(MANIFESTS)]
    folder = F.regexp_replace("path", "/[^/]+$", "")
    return both[0].unionByName(both[1]).withColumn("folder", folder).groupBy("folder").agg(
        F.min_by(F.struct("path", "content"), "rank").alias("f")).select("f.path", "f.content")


def parse_manifest(text: str) -> dict:
    """A manifest's dictionary; of one that isn't a literal, the simple entries that can be told by their shape."""
    try:
        value = ast.literal_eval(text.strip())
        if isinstance(value, dict):
            return value
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        pass
    out: dict = {k: v for k, _, v in re.findall(r"""["'](name|version|license|author|category|summary)["']\s*:\s*(["'])(.*?)\2""", text)}
    if m := re.search(r"""["']depends["']\s*:\s*\[([^\]]*)\]""", text):
        out["depends"] = re.findall(r"""["']([^"']+)["']""", m[1])
    for k, v in re.findall(r"""["'](installable|auto_install|application)["']\s*:\s*(True|False)""", text):
        out[k] = v == "True"
    return out


def module_rows(manifests: DataFrame) -> DataFrame:
    """Module rows of (path, content); a module without ``installable`` is installable."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for path, text in zip(b["path"], b["content"]):
                d = parse_manifest(text or "")
                word = lambda k: str(d[k]) if d.get(k) else None  # noqa: B023, E731
                assets = d.get("assets") if isinstance(d.get("assets"), dict) else {}
                out.append((path, path.rsplit("/", 2)[-2], word("name"), word("version"), word("license"),
                    ", ".join(d["author"]) if isinstance(d.get("author"), (list, tuple)) else word("author"), word("category"),
                        [str(x) for x in d.get("depends") or []], bool(d.get("auto_install")), bool(d.get("application")),
                            bool(d.get("installable", True)), bool(d), {str(k): repr(v) for k, v in assets.items()}))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MODULE.split(", ")])

    return manifests.mapInPandas(parse, MODULE)


def license_action(license_: Column) -> Column:
    """serve, ingest_flagged or skip."""
    policy = F.create_map(*[F.lit(x) for kv in LICENSE_POLICY.items() for x in kv])
    return F.coalesce(policy[license_], F.lit("serve"))


#: Licences of community modules, of enterprise ones, and of commercial ones by third parties.
COMMUNITY_LICENSES = ("LGPL-3", "LGPL-3.0", "GPL-3", "GPL-3.0", "AGPL-3", "AGPL-3.0")
ENTERPRISE_LICENSE, COMMERCIAL_LICENSE = "OEEL-1", "OPL-1"


def edition(name: Column, license_: Column, author: Column, path: Column, prefixes: Sequence[str] = (), authors: Sequence[str] = (),
    association: str | None = None, vendor: str = "vendor", member: str = "association") -> Column:
    """Edition of a module; the first rule that fits.

    A vendor's modules are known by name ``prefixes``, or by its ``authors`` where the licence is commercial; those of an ``association`` by
    its name in the licence. All three are the caller's. Community modules have a free licence and lie in an ``addons`` folder.
    """
    licence = F.upper(F.coalesce(license_, F.lit("")))
    some = lambda tests: reduce(lambda a, b: a | b, tests, F.lit(False))
    mine = some([name.startswith(p) for p in prefixes])
    written = some([F.coalesce(author.contains(a), F.lit(False)) for a in authors])
    return (
        F.when(mine, vendor).when(licence == ENTERPRISE_LICENSE, "enterprise").when((licence == COMMERCIAL_LICENSE) & written, vendor)
        .when(licence.contains(association.upper()) if association else F.lit(False), member).when(
            licence.isin(*COMMUNITY_LICENSES) & F.coalesce(path.contains("/addons/"), F.lit(False)), "community").otherwise("custom")
    )


def registry(modules: DataFrame, branch: str | None) -> DataFrame:
    """Installable modules that may be served, with version and licence; repositories say the branch.

    Modules whose manifest can't be read, or whose version neither manifest nor branch tells, are left out.
    """
    version = manifest_version(F.col("version_raw"), F.lit(branch))
    major = F.split(version, r"\.")[0].try_cast("int")
    licensed = modules.filter("installable and readable").withColumn("version", version).filter("version <> 'unknown'")
    implied = F.coalesce("license", F.when(major <= 8, "AGPL-3").otherwise("LGPL-3"))
    return licensed.withColumn("license", implied).withColumn("action", license_action(F.col("license"))).filter(F.col("action") != "skip")


def dependency_edges(modules: DataFrame) -> DataFrame:
    return modules.select(F.col("name").alias("src"), F.explode("depends").alias("dst"), "version").distinct()


def asset_contributions(modules: DataFrame) -> DataFrame:
    """(module, bundle, entries as JSON text, includes): what a manifest adds to each bundle."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for b in batches:
            entries, includes = [], []
            for raw in b["raw"]:
                value = ast.literal_eval(raw)
                value = list(value) if isinstance(value, (list, tuple)) else [value]
                entries.append(json.dumps(value))
                includes.append([x[1] for x in value if isinstance(x, (list, tuple)) and len(x) == 2 and x[0] == "include"])
            yield pd.DataFrame({"module": b["module"], "bundle": b["bundle"], "entries": entries, "includes": includes})

    flat = modules.select(F.col("name").alias("module"), F.explode("assets").alias("bundle", "raw"))
    return flat.mapInPandas(parse, "module string, bundle string, entries string, includes array<string>")
