"""Table versions, and the small logs that go with them, under one root folder.

A treated table is written as a new version next to the old one and becomes current
with one commit file, created only if no file of that version is there: of two runs that
began with one version one commits, the other fails and leaves its files as leftovers.
Nothing is ever changed in place. A run that dies before its commit leaves the old
version in force. All logs are append-only and may be read by any session; rows the
driver knows are written by it, a file for each step, without a job.
"""

import json
import re
import uuid
from datetime import datetime, timezone
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.plans.registry import ENTRY

COMMIT = "table string, version bigint, path string, format string, run string, committed timestamp"
RANGE_PLAN = "run string, table string, base bigint, number bigint, upto string, n_rows bigint"
RANGE_DONE = ("run string, table string, number bigint, upto string, rows bigint, "
              "counts map<string, bigint>, at timestamp")
OPERATION = ("run string, table string, column string, phase string, rows bigint, n_distinct bigint, "
             "skipped bigint, seconds double, error_class string, at timestamp")
PROGRESS = "run string, table string, done bigint, total bigint, at timestamp"
_STAGED = re.compile(r"^run-[0-9a-f]{12}$")
# Columns of staged files that tell what was done to a row; no reader of the table sees them.
FLAG = "__flag_"
RANGE = "__range"


# What a row of each log cannot do without; a row that lacks it is damaged.
_REQUIRED = {"commits": ("table", "version", "path"), "range_plan": ("run", "table", "number"),
             "ranges_done": ("run", "table", "number"), "registry": ("table", "column", "version", "state")}


def whole_rows(log: DataFrame, name: str) -> DataFrame:
    """The log, failing closed at a row without its key: better no run than a run
    that takes an encrypted column for a clear one."""
    for column in _REQUIRED.get(name, ()):
        damaged = F.raise_error(F.lit(f"the log {name} is damaged: a row has no {column}"))
        log = log.withColumn(column, F.coalesce(column, damaged.cast(log.schema[column].dataType)))
    return log


class ConflictingCommit(RuntimeError):
    """Another run made a version of the table since this one began."""


def _now():
    return datetime.now(timezone.utc).isoformat()


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- folders ------------------------------------------------------------------
    def _path(self, text):
        return self.spark._jvm.org.apache.hadoop.fs.Path(text)

    def _files(self, text):
        return self._path(text).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, text):
        return self._files(text).exists(self._path(text))

    def _folders(self, text):
        if not self._exists(text):
            return []
        return sorted(s.getPath().getName() for s in self._files(text).listStatus(self._path(text))
                      if s.isDirectory())

    # -- logs ---------------------------------------------------------------------
    def _log(self, name, schema) -> DataFrame:
        folder = f"{self.root}/{name}"
        if not self._exists(folder):
            return self.spark.createDataFrame([], schema)
        return whole_rows(self.spark.read.schema(schema).json(folder, mode="FAILFAST"), name)

    def _append(self, name, rows: DataFrame):
        rows.coalesce(1).write.mode("append").json(f"{self.root}/{name}")

    def _create(self, path, rows):
        """Write rows as lines of a new file; False if there is one already."""
        files, target = self._files(path), self._path(path)
        if files.exists(target):
            return False
        try:
            out = files.create(target, False)
        except Exception as error:                      # another writer was faster
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        out.write(bytearray("".join(json.dumps({k: v for k, v in r.items() if v is not None}) + "\n" for r in rows).encode()))
        out.close()
        return True

    def _note(self, name, rows):
        """Append rows that the driver knows."""
        self._create(f"{self.root}/{name}/note-{uuid.uuid4().hex}.json", rows)

    def commits(self):
        return self._log("commits", COMMIT)

    def registry(self) -> DataFrame:
        """The registry, with the last finished key of runs that write by range."""
        log = self._log("registry", ENTRY)
        last = self.ranges_done().groupBy("run", "table").agg(F.max_by("upto", "number").alias("__last"))
        return log.join(last, ["run", "table"], "left").withColumn(
            "last_key", F.coalesce("last_key", "__last")).select(*log.columns)

    def append_registry(self, rows: DataFrame):
        self._append("registry", rows)

    def range_plan(self):
        return self._log("range_plan", RANGE_PLAN)

    def ranges_done(self):
        return self._log("ranges_done", RANGE_DONE)

    def operations(self):
        return self._log("operations", OPERATION)

    def log_operation(self, run, table, column, phase, rows=None, n_distinct=None, skipped=None,
                      seconds=None, error_class=None):
        """Counts, phases and error classes - never a value."""
        self._note("operations", [dict(run=run, table=table, column=column, phase=phase, rows=rows, n_distinct=n_distinct,
                                       skipped=skipped, seconds=seconds, error_class=error_class, at=_now())])

    def log_progress(self, run, table, done, total):
        """Rows done so far, as told by the tasks that have ended."""
        self._note("progress", [dict(run=run, table=table, done=done, total=total, at=_now())])

    def progress(self) -> DataFrame:
        """``(table, column, done, total, seconds)`` of runs, by their ranges or, where a
        table is written at once, by the tasks that have ended."""
        done = self.ranges_done().groupBy("run", "table").agg(
            F.sum("rows").alias("done"), F.max("at").alias("__at"))
        total = self.range_plan().groupBy("run", "table").agg(F.sum("n_rows").alias("total"))
        by_range = total.join(done, ["run", "table"], "left").select(
            "run", "table", F.coalesce("done", F.lit(0)).alias("done"), "total", "__at")
        by_task = self._log("progress", PROGRESS).groupBy("run", "table").agg(
            F.max("done").alias("done"), F.max("total").alias("total"), F.max("at").alias("__at"))
        started = self._log("registry", ENTRY).groupBy("run", "table", "column").agg(
            F.min("updated").alias("__since"))
        return started.join(by_range.unionByName(by_task), ["run", "table"]).select(
            "table", "column", "done", "total", (F.col("__at").cast("double") - F.col("__since").cast("double")).alias("seconds"))

    # -- versions -----------------------------------------------------------------
    @staticmethod
    def new_run():
        return f"run-{uuid.uuid4().hex[:12]}"

    def staging(self, table, run):
        return f"{self.root}/tables/{table}/{run}"

    def register(self, table: str, path: str, fmt="parquet"):
        """Make existing files the first version of a table; they are only read."""
        self._commit(table, path, fmt, None)

    def _commit(self, table, path, fmt, run, base=None):
        entry = self.current(table)
        version = (entry["version"] if entry else 0) + 1
        if base is not None and version != base + 1:
            raise ConflictingCommit(f"{table} has version {version - 1}; this run began with {base}")
        row = dict(table=table, version=version, path=path, format=fmt, run=run, committed=_now())
        if not self._create(f"{self.root}/commits/{quote('v-' + table, safe='')}-{version:012d}.json", [row]):
            raise ConflictingCommit(f"another run committed version {version} of {table}")

    def commit(self, table, run, base=None):
        """Make a finished run the current version, if that is still ``base``."""
        self._commit(table, self.staging(table, run), "parquet", run, base)

    def current(self, table, version=None):
        rows = self.commits().where(F.col("table") == table)
        if version is not None:
            rows = rows.where(F.col("version") == version)
        return rows.orderBy(F.col("version").desc()).first()

    def tables(self) -> DataFrame:
        return self.commits().select("table").distinct().orderBy("table")

    def read(self, table, version=None) -> DataFrame:
        entry = self.current(table, version)
        if entry is None:
            raise LookupError(f"no table {table}")
        reader = self.spark.read.format(entry["format"])
        if entry["run"]:
            reader = reader.option("recursiveFileLookup", "true")
        found = reader.load(entry["path"])
        return found.drop(*[c for c in found.columns if c.startswith(FLAG)]) if entry["run"] else found

    def write(self, table, run, rows: DataFrame, by_range=False):
        """Write staged files, all at once or a folder for each value of ``RANGE``.

        By range, each task's files are in place when it ends, so what a job that
        breaks off had finished is not lost.
        """
        target = self.staging(table, run)
        if not by_range:
            rows.write.mode("overwrite").parquet(target)
            return
        writer = rows.repartition(F.col(RANGE)).write.mode("append").partitionBy(RANGE)
        writer.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(target)

    def staged_ranges(self, table, run):
        """The rows that were written by range so far, or None."""
        path = self.staging(table, run)
        if not any(f.startswith(f"{RANGE}=") for f in self._folders(path)):
            return None
        return self.spark.read.parquet(path).withColumn(RANGE, F.col(RANGE).cast("bigint"))

    def touched(self, table, run, name):
        """Rows that a run's files mark with a flag, or None where they have no such flag."""
        path = self.staging(table, run)
        if not self._exists(path):
            return None
        found = self.spark.read.option("recursiveFileLookup", "true").parquet(path)
        return found.where(F.col(f"`{FLAG}{name}`")).count() if FLAG + name in found.columns else None

    def drop_staged_range(self, table, run, number):
        path = f"{self.staging(table, run)}/{RANGE}={number}"
        self._files(path).delete(self._path(path), True)

    # -- leftovers ------------------------------------------------------------------
    def leftovers(self) -> DataFrame:
        """``(table, run, path)`` of staged files without a commit; normally none."""
        staged = [(t, r, self.staging(t, r)) for t in self._folders(f"{self.root}/tables")
                  for r in self._folders(f"{self.root}/tables/{t}") if _STAGED.match(r)]
        rows = self.spark.createDataFrame(staged, "table string, run string, path string")
        return rows.join(self.commits().select("run"), "run", "left_anti").select("table", "run", "path")

    def count_leftover(self, table, run) -> int:
        """Rows in a leftover, to be shown before it is dropped."""
        return (self.spark.read.option("recursiveFileLookup", "true")
                .parquet(self.staging(table, run)).count())

    def drop_leftover(self, table, run, confirm=False):
        """Remove one leftover; a committed version is never removed."""
        if not confirm:
            raise ValueError("pass confirm=True; a run that is writing now would fail")
        if self.leftovers().where((F.col("table") == table) & (F.col("run") == run)).isEmpty():
            raise LookupError(f"{table}/{run} is not a leftover")
        path = self.staging(table, run)
        self._files(path).delete(self._path(path), True)
