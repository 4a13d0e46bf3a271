"""Scenario store: partial aggregates of measurement files, kept up to date.

A store grows by batches.  A batch holds the partial aggregates (sum, count and
least unit per file, site, day and criterion) of the files that were new when
it was made, a manifest of those files (path, length, modification time) and,
written last, a completion mark.  A later run reads only files that no batch
has in their present form: partials are mergeable, so new files never cause old
ones to be read again.  A file that changed is read again and its older
partials no longer count; a file that is gone no longer counts either.  A batch
without its mark (the job died while writing) is passed over and its files are
read again.

    <store>/batch-<id>/partials/   Parquet, column ``file`` names the source
    <store>/batch-<id>/files/      the manifest
    <store>/batch-<id>/_COMPLETE   the mark
    <store>/daily-<digest>/        a finished scenario table with its labels,
                                   named after the files it was made from

One writer at a time; readers only ever see complete batches.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagscope.sources import sinks

#: Columns of a partial aggregate; the last three merge by sum, sum and min.
KEYS = ("lat", "lon", "date", "criteria")
_MANIFEST = "file string, path string, length bigint, modified bigint"


@dataclass(frozen=True, order=True)
class SourceFile:
    """A file as the file system lists it; ``file`` is its path as an URI, the
    form in which Spark names a row's file."""
    file: str
    path: str
    length: int
    modified: int


def list_files(spark: SparkSession, globs: Sequence[str]) -> list[SourceFile]:
    """The files of the globs, each once.  Their number is that of source
    files (class x year), not of rows."""
    found = set()
    for g in globs:
        path, fs = sinks.hadoop_path(spark, g)
        for st in fs.globStatus(path) or []:
            if st.isFile():
                found.add(SourceFile(st.getPath().toUri().toString(), st.getPath().toString(), st.getLen(),
                                     st.getModificationTime()))
    return sorted(found)


class PartialStore:
    """The store under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def batches(self) -> list[str]:
        """Names of the complete batches."""
        path, fs = sinks.hadoop_path(self.spark, self.root)
        if not fs.exists(path):
            return []
        names = sorted(st.getPath().getName() for st in fs.listStatus(path))
        return [n for n in names if n.startswith("batch-") and sinks.is_complete(self.spark, f"{self.root}/{n}")]

    def held(self) -> dict[SourceFile, str]:
        """Files as they were read, with the batch that has them (the last
        one, if several have)."""
        paths = {n: f"{self.root}/{n}/files" for n in self.batches()}
        out: dict[SourceFile, str] = {}
        for name, path in paths.items():
            for r in self.spark.read.schema(_MANIFEST).parquet(path).collect():
                out[SourceFile(r["file"], r["path"], r["length"], r["modified"])] = name
        return out

    def update(self, files: Sequence[SourceFile], read: Callable[[list[str]], DataFrame]) -> list[SourceFile]:
        """Add a batch of those of ``files`` that the store does not have in
        their present form, and return them.  ``read`` gives the partials
        (``file``, KEYS, ``_s``, ``_n``, ``_u``) of a list of paths."""
        held = self.held()
        new = [f for f in files if f not in held]
        if new:
            # the number orders the batches, the rest keeps names apart
            seq = len(self.batches())
            path = f"{self.root}/batch-{seq:08d}-{uuid.uuid4().hex}"
            read([f.path for f in new]).write.parquet(f"{path}/partials")
            rows = [(f.file, f.path, f.length, f.modified) for f in new]
            self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{path}/files")
            sinks.mark_complete(self.spark, path)
        return new

    def partials(self, files: Iterable[SourceFile]) -> DataFrame:
        """The merged partials of ``files``, all of which the store holds: one
        row per KEYS with ``_s``, ``_n``, ``_u``."""
        held = self.held()
        wanted: dict[str, list[str]] = {}
        for f in files:
            wanted.setdefault(held[f], []).append(f.file)
        union = None
        for name, of in sorted(wanted.items()):
            rows = self.spark.read.parquet(f"{self.root}/{name}/partials")
            keep = self.spark.createDataFrame([(f,) for f in of], "file string")
            rows = rows.join(keep, "file", "left_semi").drop("file")
            union = rows if union is None else union.unionByName(rows)
        if union is None:
            raise FileNotFoundError("no measurement files matched")
        return union.groupBy(*KEYS).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.min("_u").alias("_u"))

    def daily(self, files: Sequence[SourceFile], definition: str,
              make: Callable[[DataFrame], tuple[DataFrame, list[str]]]) -> tuple[DataFrame, list[str]]:
        """The scenario table that ``make`` gives for the partials of
        ``files``, and its labels: reloaded where a complete one was made from
        the very same files by the same ``definition``, else made and kept."""
        said = "\n".join([definition, *(f"{f.file}\t{f.length}\t{f.modified}" for f in sorted(files))])
        path = f"{self.root}/daily-{hashlib.sha256(said.encode()).hexdigest()[:32]}"
        if not sinks.is_complete(self.spark, path):
            table, labels = make(self.partials(files))
            # what an interrupted run left under this name is replaced
            sinks.materialize(table, path, labels, mode="overwrite")
        return sinks.read_scenario(self.spark, path)
