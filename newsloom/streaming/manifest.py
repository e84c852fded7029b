"""A store of folders whose readers always see one committed version."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Versions of the manifest that stay readable.
KEPT_VERSIONS = 3


class Manifest:
    """Which folders under ``path`` hold the rows, as one small JSON row for each version.

    A version counts from the moment its file is there, which Spark's commit protocol moves into place as a whole.
    Folders that a version replaces are removed when the next one is committed, so whoever
    planned a read on the version before still finds them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    def latest(self) -> dict | None:
        """The newest version: its number and what was committed with it; None before the first."""
        try:
            rows = (
                self.spark.read.schema("version long, body string")
                .option("recursiveFileLookup", True)
                .json(f"{self.path}/manifest")
            )
        except AnalysisException as problem:
            if problem.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        row = rows.orderBy(F.col("version").desc()).first()
        return None if row is None else {"version": row["version"], **json.loads(row["body"])}

    def commit(self, version: int, folders: list[str], replaced: list[str], **more: object) -> None:
        """Make ``folders`` the rows of ``version``; those in ``replaced`` are removed with the next commit."""
        last = self.latest()
        history = [*(last["history"] if last else []), version]
        body = {"folders": folders, "replaced": replaced, "history": history[-KEPT_VERSIONS:], **more}
        row = self.spark.createDataFrame([(version, json.dumps(body))], "version long, body string")
        row.coalesce(1).write.mode("overwrite").json(f"{self.path}/manifest/{version}")
        if last:
            old = [f"manifest/{v}" for v in history[:-KEPT_VERSIONS]]
            self._remove([x for x in last["replaced"] if x not in folders] + old)

    def read(self, folders: list[str], schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in folders])

    def _remove(self, folders: list[str]) -> None:
        jvm = self.spark._jvm
        for folder in folders:
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


class MergedRuns:
    """Sums per key that grow batch by batch, in few sorted-by-age runs.

    A batch is folded to one row per key and written as a run of level 0. As soon as ``fanout`` runs of one
    level are the newest, they are folded into one run of the next level. After n batches there are
    at most (fanout - 1) runs on each of about log(n) levels, and a row has been rewritten once a level. A
    batch that was committed already is not added again; one that failed before its commit writes
    the same folders anew. Sums that come to nothing, as after a correction, go.
    """

    def __init__(self, spark: SparkSession, path: str, keys: dict[str, str], sums: list[str], fanout: int = 4):
        self.manifest = Manifest(spark, path)
        self.keys, self.sums, self.fanout = list(keys), sums, fanout
        self.schema = ", ".join([*(f"{c} {kind}" for c, kind in keys.items()), *(f"{c} long" for c in sums)])

    def _folded(self, rows: DataFrame) -> DataFrame:
        total = rows.groupBy(*self.keys).agg(*[F.sum(c).cast("long").alias(c) for c in self.sums])
        left = F.lit(False)
        for c in self.sums:
            left = left | (F.col(c) != 0)
        return total.where(left)

    def _write(self, rows: DataFrame, folder: str) -> None:
        self._folded(rows).write.mode("overwrite").parquet(f"{self.manifest.path}/{folder}")

    def add(self, rows: DataFrame, batch: int) -> None:
        """Add the rows of batch number ``batch``; numbers go up."""
        last = self.manifest.latest() or {"version": -1, "runs": []}
        if batch <= last["version"]:
            return
        folder = f"runs/{batch}-0"
        self._write(rows, folder)
        runs, replaced = [*last["runs"], [0, folder]], []
        while len(runs) >= self.fanout and {level for level, _ in runs[-self.fanout :]} == {runs[-1][0]}:
            level, newest = runs[-1][0], [x for _, x in runs[-self.fanout :]]
            folder = f"runs/{batch}-{level + 1}"
            self._write(self.manifest.read(newest, self.schema), folder)
            replaced += newest
            runs = [*runs[: -self.fanout], [level + 1, folder]]
        self.manifest.commit(batch, [x for _, x in runs], replaced, runs=runs)

    def folders(self) -> list[str]:
        """The folders that a read touches now."""
        last = self.manifest.latest()
        return last["folders"] if last else []

    def rows(self) -> DataFrame:
        """One row per key, of the newest version."""
        return self._folded(self.manifest.read(self.folders(), self.schema))
