"""Sharding by size-tiered compaction.

Arrivals are appended as runs of small immutable files. Runs of similar size
form a tier; as soon as a tier has enough of them they are merged, without a
shuffle, into one run of target-sized files. What is live is said by a
versioned manifest: a version is written aside and renamed into place, which
one writer only can do, so readers see the old state or the new one; the other
writer starts again from what it finds. Runs have names of their own, so what a
lost writer leaves behind is in nobody's way. Data files are never changed;
``vacuum`` removes old files that no kept version names.
"""

from __future__ import annotations

import math
import time
import uuid
from collections.abc import Callable
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import scratch, stored_bytes, unused

TARGET = 128 << 20
FANOUT = 4
#: Runs below this size are one tier; each further tier is ``FANOUT`` times larger.
BASE = 1 << 20
#: Merges that are submitted at once, and times that a commit is tried again on top of another writer's.
AT_ONCE, ATTEMPTS = 4, 20
#: Seconds that a version stays readable after a newer one, and that a run may wait for its commit.
RETENTION = 7 * 24 * 3600.0
MANIFEST = "run string, bytes long, tier int, files long, merged boolean"


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was about to."""


class ShardStore:
    """Immutable runs of Parquet files below ``root``, and their manifests."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT, base: int = BASE):
        self.spark, self.root, self.target, self.fanout, self.base = spark, root.rstrip("/"), target, fanout, base
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        self._fs.mkdirs(self._path(f"{self.root}/runs"))

    def versions(self) -> list[int]:
        return sorted(int(x.getPath().getName()[1:]) for x in self._fs.listStatus(self._path(f"{self.root}/manifests")) if x.getPath().getName().startswith("v"))

    def version(self) -> int:
        """The newest committed version; 0 before the first."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> list[dict]:
        """Live runs of a version: a row for each run, not for each document."""
        version = self.version() if version is None else version
        if not version:
            return []
        rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests/v{version:08d}").collect()
        return sorted((r.asDict() for r in rows), key=lambda r: r["run"])

    def commit(self, runs: list[dict], based_on: int) -> int:
        """Make ``runs`` the version after ``based_on``, or raise ``CommitConflict``."""
        aside, final = f"{self.root}/manifests/_{uuid.uuid4().hex}", f"{self.root}/manifests/v{based_on + 1:08d}"
        self.spark.createDataFrame([(r["run"], r["bytes"], r["tier"], r["files"], r["merged"]) for r in runs], MANIFEST).coalesce(1).write.json(aside)
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        how = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(self._path(aside), self._path(final), how)  # fails if the version is there
        except Exception as e:
            self._fs.delete(self._path(aside), True)
            if self._fs.exists(self._path(final)):
                raise CommitConflict(f"version {based_on + 1} was committed by another writer") from e
            raise
        return based_on + 1

    def _sizes(self, run: str) -> list[int]:
        """Bytes of each data file of a run."""
        return [x.getLen() for x in self._fs.listStatus(self._path(f"{self.root}/runs/{run}")) if x.isFile() and not x.getPath().getName().startswith(("_", "."))]

    def _tier(self, size: int) -> int:
        return 0 if size < self.base else 1 + int(math.log(size / self.base) / math.log(self.fanout) + 1e-9)

    def _entry(self, run: str, merged: bool = False) -> dict:
        sizes = self._sizes(run)
        return {"run": run, "bytes": sum(sizes), "tier": self._tier(sum(sizes)), "files": len(sizes), "merged": merged}

    def _files(self, size: int) -> int:
        """Target-sized files that hold so many bytes."""
        return max(1, -(-size // self.target))

    def _change(self, gone: set[str], new: list[dict]) -> int:
        """Commit the newest version less ``gone`` and with ``new``, again if another writer was first. Raises if it has taken ``gone`` away."""
        for attempt in range(ATTEMPTS):
            based_on = self.version()
            live = {r["run"]: r for r in self.manifest(based_on)}
            if not gone <= live.keys():
                raise CommitConflict("another writer has merged the same runs")
            try:
                return self.commit([r for name, r in live.items() if name not in gone] + new, based_on)
            except CommitConflict:
                if attempt == ATTEMPTS - 1:
                    raise
        raise AssertionError

    def append(self, rows: DataFrame, arrival=None) -> int:
        """Add ``rows`` as one run, or as one run for each value of the column expression ``arrival``, in one commit.

        Nothing is shuffled: each task writes its own small files.
        """
        name = f"r{self.version() + 1:08d}-{uuid.uuid4().hex[:12]}"
        if arrival is None:
            rows.write.parquet(f"{self.root}/runs/{name}")
            new = [name]
        else:
            column = unused(rows, "__arrival")
            rows.withColumn(column, arrival).write.partitionBy(column).parquet(f"{self.root}/runs/{name}")
            parts = [x.getPath().getName() for x in self._fs.listStatus(self._path(f"{self.root}/runs/{name}")) if x.isDirectory()]
            new = [f"{name}/{x}" for x in sorted(parts, key=lambda x: (len(x), x))]
        return self._change(set(), [self._entry(x) for x in new])

    def plan(self, runs: list[dict]) -> list[list[dict]]:
        """Groups of ``fanout`` runs of one tier, oldest first, that are due to be merged, and runs that are due to be rewritten alone.

        A merged run of ``fanout`` target sizes or more rests: it lies in
        target-sized files. An appended one of any size is in the files that
        its tasks wrote; where it has more of them than target-sized files
        would be and no group takes it, it is rewritten alone, once.
        """
        due = []
        tiers: dict[int, list[dict]] = {}
        for r in runs:
            if r["bytes"] < self.target * self.fanout:
                tiers.setdefault(r["tier"], []).append(r)
            elif self._scattered(r):
                due.append([r])
        for tier in sorted(tiers):
            own = sorted(tiers[tier], key=lambda r: (len(r["run"]), r["run"]))
            full = len(own) // self.fanout * self.fanout
            due += [own[i : i + self.fanout] for i in range(0, full, self.fanout)]
            due += [[r] for r in own[full:] if r["bytes"] >= self.target and self._scattered(r)]
        return due

    def _scattered(self, r: dict) -> bool:
        return not r["merged"] and r["files"] > self._files(r["bytes"])

    def _merge(self, group: list[dict], name: str) -> dict:
        files = self._files(sum(r["bytes"] for r in group))
        self.scan([r["run"] for r in group]).coalesce(files).write.parquet(f"{self.root}/runs/{name}")
        return self._entry(name, merged=True)

    def compact(self) -> int:
        """Merge until no tier is full; each round is one commit, its merges are submitted a few at once. Returns the newest version."""
        while due := self.plan(self.manifest()):
            stem = f"m{self.version() + 1:08d}-{uuid.uuid4().hex[:12]}"
            work: list[Callable] = [lambda g=g, i=i: self._merge(g, f"{stem}-{i:04d}") for i, g in enumerate(due)]
            with ThreadPool(AT_ONCE) as pool:
                new = pool.map(inheritable_thread_target(self.spark)(lambda f: f()), work)
            try:
                self._change({r["run"] for g in due for r in g}, new)
            except CommitConflict:
                continue  # plan again from what the other writer has left
        return self.version()

    def scan(self, runs: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/runs/{x}" for x in runs])

    def read(self, version: int | None = None, placed: bool = False) -> DataFrame | None:
        """Rows of a version (None if it has no run); with ``placed`` also ``run`` (its place in the manifest, from 0), ``tier`` and ``version``."""
        version = self.version() if version is None else version
        live = self.manifest(version)
        if not live:
            return None
        rows = self.scan([r["run"] for r in live])
        if not placed:
            return rows
        own = ["run", "tier", "version"]
        found, place, of = (unused(rows, x) for x in ("__run", "__at", "__of"))
        # The manifest has a row for each run; read from its file, Spark knows its size and broadcasts it while it is small.
        at = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifests/v{version:08d}")
        nth = (F.row_number().over(Window.orderBy("run")) - 1).cast("long")
        at = at.select(F.col("run").alias(of), F.struct(nth.alias("run"), "tier").alias(place))
        kept = [c for c in rows.columns if c not in own]
        rows = rows.withColumn(found, F.regexp_extract(F.col("_metadata.file_path"), "/runs/(.+)/[^/]+$", 1)).join(at, F.col(found) == F.col(of))
        return rows.select(*kept, F.col(f"{place}.run").alias("run"), F.col(f"{place}.tier").alias("tier"), F.lit(version).cast("long").alias("version"))

    def vacuum(self, keep: int = 1, older_than: float = RETENTION) -> None:
        """Drop versions that are neither among the newest ``keep`` nor younger than ``older_than`` seconds, and runs as old that no version left names.

        A run that another writer has yet to commit is younger than that, and a
        reader of an old version has as long to finish.
        """
        limit = (time.time() - older_than) * 1000
        every = self.versions()
        kept = [v for v in every if v in every[-keep:] or self._fs.getFileStatus(self._path(f"{self.root}/manifests/v{v:08d}")).getModificationTime() > limit]
        live = {r["run"] for v in kept for r in self.manifest(v)}
        for v in every:
            if v not in kept:
                self._fs.delete(self._path(f"{self.root}/manifests/v{v:08d}"), True)
        for top in self._fs.listStatus(self._path(f"{self.root}/runs")):
            name, below = top.getPath().getName(), self._fs.listStatus(top.getPath())
            if max([top.getModificationTime(), *[x.getModificationTime() for x in below]]) > limit:
                continue
            inner = [x.getPath().getName() for x in below if x.isDirectory()]
            for run in [f"{name}/{x}" for x in inner] or [name]:
                if run not in live:
                    self._fs.delete(self._path(f"{self.root}/runs/{run}"), True)


def shard_documents(docs: DataFrame, arrivals: int = 10, target: int = TARGET, fanout: int = FANOUT, base: int = BASE, root: str | None = None) -> DataFrame:
    """Documents as a store holds them after their arrivals have been appended and compacted.

    :param docs: all columns are stored; ``doc_id`` and ``text`` are returned with their place.
    :param arrivals: at most so many, and more where the input's files would make arrivals of over ``fanout`` target
        sizes. A task's rows come in ``fanout`` arrivals at most, so files grow in proportion to the input.
    :param root: where the store lies; None: a new folder below the shared one.
    :return: ``doc_id, n_bytes, run, tier, version``, one row for each input row.

    Files are cut by size and not by any key, so a source or a group of copies
    of whatever size spreads over them. Null texts (0 bytes), null ids, empty
    and very long texts and repeated rows are stored as they are. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or scratch(spark, "shards"), target, fanout, base)
    arrivals = max(arrivals, -(-stored_bytes(docs) // (target * fanout)))
    store.append(docs, F.pmod(F.spark_partition_id() * fanout + F.pmod(F.xxhash64("doc_id"), F.lit(fanout)), F.lit(arrivals)))
    store.compact()
    store.vacuum()  # what an earlier call has left in ``root``; nothing of this one
    out = store.read(placed=True)
    if out is None:
        out = docs.withColumns({"run": F.lit(0).cast("long"), "tier": F.lit(0), "version": F.lit(store.version()).cast("long")}).limit(0)
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "run", "tier", "version")
