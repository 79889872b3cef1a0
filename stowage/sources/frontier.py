"""Listing a tree of any shape by many tasks: unlisted folders are dealt out anew in rounds, and file attributes are read in a stage of
their own, so that neither one deep folder nor one with very many files is the work of one task."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.operators.ranges import ranged, stored
from stowage.sources.inventory import SCHEMA, _entry

#: A task goes on below a folder until it has found so many entries; folders that it then hasn't listed go to the next round.
ENTRIES = 10_000
#: Open folders that a task of the next round has; a number of tasks is named, since rows as small as these would be put in one task.
FOLDERS = 20
#: Rows sent on at once: a folder's names are never held together by a task.
ROWS = 4096
_FOUND = "kind string, rel_path string, open boolean"


def _below(root: str, folder: str, most: int) -> Iterator[tuple[str, str, bool]]:
    """(kind, path, open) of the entries below a folder; open: a folder left for the next round. Links to folders and folders that
    can't be read have nothing below them, the former don't show either."""
    todo, n = [folder], 0
    while todo:
        here = todo.pop()
        if n >= most and here != folder:
            yield "dir", here, True
            continue
        if here != folder:
            yield "dir", here, False
        try:
            with os.scandir(os.path.join(root, here)) as entries:
                for e in entries:
                    path = f"{here}/{e.name}" if here else e.name
                    n += 1
                    if e.is_dir(follow_symlinks=False):
                        todo.append(path)
                    elif not e.is_dir():
                        yield "file", path, False
        except OSError:
            continue


def _listed(root: str, most: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for folder in pdf["rel_path"]:
                for row in _below(root, folder, most):
                    rows.append(row)
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=["kind", "rel_path", "open"])
                        rows = []
        yield pd.DataFrame(rows, columns=["kind", "rel_path", "open"])

    return run


def _described(root: str, head: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_entry(root, os.path.join(root, rel), kind, seq, head) for kind, rel, seq in zip(pdf["kind"], pdf["rel_path"], pdf["walk_seq"], strict=True)]
            yield pd.DataFrame(rows, columns=["kind", "rel_path", "name", "size", "mtime_epoch", "walk_seq", "head"])

    return run


def list_tree(spark: SparkSession, root: str, head: bool = False, below: str = "") -> DataFrame:
    """The rows of read_inventory for the tree at root, or of the part below a folder of it, in the same order by walk_seq: a folder, its
    files by name, then what its folders hold, by name.

    Each round lists the open folders, one task having its share of them; a folder is listed again by nobody. Rounds end when no folder
    is open, after as many as the tree is deep at most. Only how many are open comes to the driver. What vanishes meanwhile has size
    and time 0. An empty or missing folder gives no rows.
    """
    root = os.path.abspath(root)
    tasks = spark.sparkContext.defaultParallelism
    found, open_ = [], spark.createDataFrame([(below.strip("/"),)], "rel_path string")
    n = 1
    while n:
        rows = stored(open_.mapInPandas(_listed(root, ENTRIES), _FOUND), "listed")
        found.append(rows.select("kind", "rel_path"))
        open_ = rows.where("open").select("rel_path")
        n = open_.count()
        open_ = open_.repartition(max(tasks, -(-n // FOLDERS)), "rel_path")
    entries = found[0]
    for more in found[1:]:
        entries = entries.union(more)
    steps = F.split("rel_path", "/")
    last = F.size(steps) - 1
    order = F.transform(steps, lambda s, i: F.struct(((i < last) | (F.col("kind") == "dir")).alias("inside"), s.alias("name")))
    at = ranged(entries.withColumn("_order", order), ["_order"])
    dealt = at.select("kind", "rel_path", F.col("_at").alias("walk_seq")).repartition(max(tasks, -(-at.count() // ENTRIES)), "rel_path")
    return dealt.mapInPandas(_described(root, head), SCHEMA)
