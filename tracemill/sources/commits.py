"""A table that grows by commits: what is handed again, or torn off, doesn't change it.

    <path>/data/<name>~<attempt>/part-...     rows of one attempt
    <path>/commits/<name>                     the attempt that counts

A commit's rows are written first, under a folder of its own; it counts from
the moment when a file of its name is made, which fails if there is one. So a
commit handed again adds nothing, of two writers one wins, and rows of an
attempt that didn't get that far are never read. Commits are read in the order
of their names, which are numbers with leading zeros if none are given.
"""

from __future__ import annotations

import re
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources import files
from tracemill.sources.lease import Lease

NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")
DIGITS = 12


class Log:
    def __init__(self, spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> None:
        self.spark, self.path, self.schema, self.fmt = spark, path.rstrip("/"), schema, fmt

    def names(self) -> list[str]:
        """Names of the commits, in order."""
        return files.names(self.spark, f"{self.path}/commits")

    @staticmethod
    def _checked(name: str) -> str:
        if not NAME.fullmatch(name):
            raise ValueError(f"a commit can't be named {name!r}")
        return name

    def stage(self, df: DataFrame, name: str) -> str:
        """Write the rows of an attempt at `name`; they don't count yet."""
        folder = f"{self._checked(name)}~{uuid.uuid4().hex[:12]}"
        df.write.format(self.fmt).save(f"{self.path}/data/{folder}")
        return folder

    def publish(self, folder: str, lease: Lease | None = None) -> bool:
        """Let a staged attempt count, if its name hasn't one yet and the lease (if given) is held: True if it counts now."""
        if lease:
            lease.check()
        return files.create(self.spark, f"{self.path}/commits/{folder.partition('~')[0]}", folder)

    def append(self, df: DataFrame, name: str | None = None, lease: Lease | None = None) -> bool:
        """Commit df under a name, or under the next number. False if the name has been committed: nothing is computed then, or what was is dropped."""
        if name is not None:
            if files.exists(self.spark, f"{self.path}/commits/{self._checked(name)}"):
                return False
            folder = self.stage(df, name)
            if counts := self.publish(folder, lease):
                return counts
            files.delete(self.spark, f"{self.path}/data/{folder}")
            return False
        folder = self.stage(df, "next")
        while True:
            number = f"{max([int(x) for x in self.names() if x.isdigit()], default=-1) + 1:0{DIGITS}d}"
            if lease:
                lease.check()
            if files.create(self.spark, f"{self.path}/commits/{number}", folder):
                return True

    def read(self, commit: str | None = None) -> DataFrame:
        """All committed rows; commit: a column for the name of each row's commit."""
        found = self._folders()
        if not found:
            empty = self.spark.createDataFrame([], self.schema)
            return empty.withColumn(commit, F.lit("")) if commit else empty
        rows = self.spark.read.schema(self.schema).format(self.fmt).load([f"{self.path}/data/{f}" for f in found])
        if not commit:
            return rows
        of = self.spark.createDataFrame(list(found.items()), "folder string, name string")  # a row for each commit
        folder = F.regexp_extract("_metadata.file_path", r"/data/([^/]+)/[^/]*$", 1)
        named = rows.select("*", folder.alias("__folder")).join(F.broadcast(of), F.col("__folder") == F.col("folder"))
        return named.select(*rows.columns, F.col("name").alias(commit))

    def _folders(self) -> dict[str, str]:
        """Folder -> name of every commit, by name."""
        if not self.names():
            return {}
        made = self.spark.read.text(f"{self.path}/commits").select("value", "_metadata.file_name").collect()
        return {r["value"]: r["file_name"] for r in sorted(made, key=lambda r: r["file_name"])}

    def latest(self, *key: str, tie: tuple[Column, ...] = ()) -> DataFrame:
        """One row for each key: that of the last commit, then that of the largest `tie`. An aggregate, so a key of many rows is summed up where they lie."""
        rows = self.read("__commit")
        kept = [c for c in rows.columns if c != "__commit"]
        last = F.max_by(F.struct(*kept), F.struct(F.col("__commit"), *tie))
        return rows.groupBy(*key).agg(last.alias("__last")).select("__last.*")

    def sweep(self, older: float = 86400.0) -> list[str]:
        """Delete attempts that don't count and were last changed `older` seconds ago; a writer may still be at a younger one."""
        counts, gone = set(self._folders()), []
        for f in files.names(self.spark, f"{self.path}/data"):
            at = f"{self.path}/data/{f}"
            if f not in counts and files.changed(self.spark, at) < time.time() - older:
                files.delete(self.spark, at)
                gone.append(f)
        return gone
