"""Backup with a hash manifest, verified restore, and reset of snapshot folders."""

from __future__ import annotations

import re
import shutil
import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.sources.files import hash_files
from docspark.storage import Commit, Layout, Tables, delete, exists, file_system, materialize, read_version, shared_dir, under, write_version


#: Digits of a path's hash that name a node, from the leaves up: a leaf of a billion files holds some 15,000 of them, any other node 256.
LEVELS = (4, 2)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path under the folder, sha256) of every file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("size_bytes"))
    name = re.escape(folder.rstrip("/").split("/")[-1])
    return hash_files(found).select(F.regexp_extract("path", rf"{name}/(.*)$", 1).alias("path"), "sha256")


def _node(path: str, digits: int) -> Column:
    return F.substring(F.sha2(path, 256), 1, digits)


def hash_tree(manifest: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(node, sha256, n files) of the tree of hashes over a manifest, the root's node being ''.

    Paths fall into leaves by the first digits of their hashes, leaves into the nodes of fewer digits. A node hashes what is under it
    as ``name=sha256``, in order of name, with commas; so two manifests differ exactly where their nodes do, and no
    row holds more than a leaf's files. An empty manifest has no nodes.
    """
    rows = manifest.select(_node("path", levels[0]).alias("node"), F.col("path").alias("name"), F.coalesce("sha256", F.lit("")).alias("sha256"), F.lit(1).cast("bigint").alias("n"))
    tree = []
    for digits in (*levels[1:], 0, 0):
        entry = F.struct("name", F.concat("name", F.lit("="), "sha256").alias("entry"))
        listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["entry"])
        nodes = materialize(rows.groupBy("node").agg(F.sha2(F.array_join(listed, ","), 256).alias("sha256"), F.sum("n").alias("n")), "nodes")
        tree.append(nodes)
        rows = nodes.select(F.substring("node", 1, digits).alias("node"), F.col("node").alias("name"), "sha256", "n")
    return reduce(DataFrame.unionByName, tree)


def changed_files(before: DataFrame, after: DataFrame, before_tree: DataFrame | None = None, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(path, before, after) of files whose hashes differ, null where there is none: only files of leaves that differ are compared.

    ``before_tree`` is what ``hash_tree`` gave for ``before`` at these levels; it is made where it isn't given.
    """
    old = hash_tree(before, levels) if before_tree is None else before_tree
    new = hash_tree(after, levels).withColumnRenamed("sha256", "_new")
    leaf = F.length("node") == levels[0]
    nodes = old.where(leaf).select("node", "sha256").join(new.where(leaf).select("node", "_new"), "node", "full_outer")
    differ = nodes.where(~F.col("sha256").eqNullSafe(F.col("_new"))).select("node")
    within = lambda rows, name: rows.select(_node("path", levels[0]).alias("node"), "path", F.col("sha256").alias(name)).join(differ, "node", "left_semi").drop("node")
    rows = within(before, "before").join(within(after, "after"), "path", "full_outer")
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


def backup_name(name: str = "", now: float | None = None) -> str:
    """The name without blanks around it, else a UTC stamp."""
    return name.strip() or time.strftime("%Y%m%dT%H%M%SZ", time.gmtime(now))


def export(spark: SparkSession, layout: Layout, name: str = "", folder: str = "", with_registry: bool = True, zipped: bool = False) -> str:
    """Copies the index (and the registry) under ``folder`` (the layout's backups), with a manifest of hashes; gives the backup's path.

    An existing target, and one outside the layout's root, is refused. A zip archive is made of local folders only.
    """
    target = f"{(folder or layout.backups).rstrip('/')}/{backup_name(name)}"
    if not under(layout.root, target):
        raise ValueError(f"outside {layout.root}: {target}")
    if exists(spark, target):
        raise FileExistsError(target)
    read_version(spark, layout.index).write.parquet(f"{target}/index")
    if with_registry and "registry" in Tables(spark, layout.root).state()[1]:
        read_version(spark, layout.registry).write.parquet(f"{target}/registry")
    parts = [manifest(spark, f"{target}/{part}").withColumn("path", F.concat(F.lit(f"{part}/"), "path")) for part in ("index", "registry") if exists(spark, f"{target}/{part}")]
    reduce(DataFrame.unionByName, parts).coalesce(1).write.parquet(f"{target}/manifest")
    if zipped:
        shutil.make_archive(target.removeprefix("file://"), "zip", target.removeprefix("file://"))
    return target


def verify(spark: SparkSession, backup: str) -> DataFrame:
    """Files that are missing, added or changed since the backup (none: whole)."""
    kept = spark.read.parquet(f"{backup}/manifest")
    parts = [manifest(spark, f"{backup}/{part}").withColumn("path", F.concat(F.lit(f"{part}/"), "path")) for part in ("index", "registry") if exists(spark, f"{backup}/{part}")]
    if not parts:
        return kept
    now = reduce(DataFrame.unionByName, parts).withColumnRenamed("sha256", "now")
    return kept.join(now, "path", "full_outer").where(~F.col("sha256").eqNullSafe(F.col("now")))


def restore(spark: SparkSession, layout: Layout, backup: str, with_registry: bool = False, confirm: bool = False) -> None:
    """Makes a backup (a folder, or a local zip archive) the index's, and on request the registry's, current version; its manifest must hold."""
    if not confirm:
        raise ValueError("restoring replaces the index: confirm=True is needed")
    if backup.endswith(".zip"):
        folder = shared_dir(spark, "restore")
        shutil.unpack_archive(backup.removeprefix("file://"), folder.removeprefix("file://"))
        backup = folder
    for part in ("manifest", "index"):
        if not exists(spark, f"{backup}/{part}"):
            raise FileNotFoundError(f"no {part} in {backup}")
    if not verify(spark, backup).isEmpty():
        raise ValueError("the backup does not match its manifest")
    write_version(spark.read.parquet(f"{backup}/index"), layout.index)
    if with_registry and exists(spark, f"{backup}/registry"):
        write_version(spark.read.parquet(f"{backup}/registry"), layout.registry)


def reset(spark: SparkSession, folders: list[str], root: str, yes: bool = False) -> list[str]:
    """Empties the folders under ``root``, tables in a commit first; without ``yes`` only names them."""
    if outside := [f for f in folders if not under(root, f)]:
        raise ValueError(f"outside {root}: {outside}")
    commit = Commit(spark, root)
    tables = [t for t in commit.before if f"{root.rstrip('/')}/{t}" in {f.rstrip("/") for f in folders}]
    if yes and tables:
        for t in tables:
            commit.drop(t)
        commit.publish()
    for f in folders if yes else ():
        delete(spark, f)
        fs, path = file_system(spark, f)
        fs.mkdirs(path)
    return folders
