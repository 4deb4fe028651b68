"""The incident ledger as a table that micro-batches of reports are merged into, late ones too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import ledger

COLUMNS = [c for c in ledger.REPORT if c != "repeat"]


class IncidentTable:
    """Incidents under ``path`` as all reports merged so far leave them, whatever order they came in; ``merge`` is a ``foreachBatch`` function.

    The groups of reports that a batch touches are folded anew from their reports; incidents of others stay as they are. A report more than ``keep_s`` older than
    the newest one before its batch is refused (``refused`` has it). A group is done when its last report is older than that by ``remember_s`` (a window at least): no report can reach
    it any more, and its reports are let go; a message that comes again after ``remember_s`` counts as a new one. So what is kept is bounded by the reports of both times and of the groups that go on.

    Every batch writes a version: the reports still needed, the incidents, and what changed, as rows to put and rows to retract. A version counts once its mark is
    written, last; a batch number that comes again after that changes nothing, and one that failed before is done over.
    """

    def __init__(self, spark: SparkSession, path: str, keep_s: float = 86400.0, remember_s: float = 21600.0):
        self.spark, self.path, self.keep_s, self.remember_s = spark, path.rstrip("/"), keep_s, max(remember_s, ledger.WINDOW_S)

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the batches merged, the oldest first."""
        at, files = self._files(f"{self.path}/marks")
        return sorted(int(f.getPath().getName()) for f in files.listStatus(at)) if files.exists(at) else []

    def _read(self, what: str, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{what}/version={version}")

    def _write(self, df: DataFrame, what: str, version: int) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{what}/version={version}")
        return self._read(what, version)

    def incidents(self) -> DataFrame | None:
        """All incidents, or None before the first batch."""
        done = self.versions()
        return self._read("incidents", done[-1]) if done else None

    def changes(self, version: int) -> DataFrame:
        """(change, the incident's columns) of one batch: rows to ``retract``, then rows to ``put``."""
        return self._read("changes", version)

    def refused(self, version: int) -> DataFrame:
        return self._read("refused", version)

    def merge(self, batch: DataFrame, version: int) -> None:
        done = self.versions()
        if done and version <= done[-1]:
            return
        arrived = self._write(batch.select(*COLUMNS).dropDuplicates(["region", "id"]), "arrived", version)
        before, work = None, arrived
        if done:
            before, held = self._read("incidents", done[-1]), self._read("reports", done[-1])
            newest = self._read("newest", done[-1]).first().t
            in_time = (F.col("t") >= newest - self.keep_s) if newest is not None else F.lit(True)
            fresh = arrived.join(held.select("region", "id"), ["region", "id"], "left_anti")
            self._write(fresh.where(~in_time | F.col("t").isNull()), "refused", version)
            arrived = fresh.where(in_time)
            work = held.unionByName(arrived)
        else:
            newest = None
            self._write(arrived.where(F.col("t").isNull()), "refused", version)
            work = arrived.where(F.col("t").isNotNull())
        grouped = self._write(ledger.with_groups(ledger.prepared(work)), "groups", version)
        latest = self._write(grouped.agg(F.greatest(F.max("t"), F.lit(newest).cast("double")).alias("t")), "newest", version).first().t
        # A new report touches its group, and those of reports with its message, which may have become repeats.
        new = grouped.join(arrived.select("region", "id"), ["region", "id"], "left_semi")
        same = grouped.join(new.where("said is not null").select("said").distinct(), "said", "left_semi")
        touched = new.select("region", "_group").unionByName(same.select("region", "_group")).distinct()
        again = grouped.join(touched, ["region", "_group"], "left_semi")
        folded = self._write(ledger.settled(again, grouped), "folded", version)
        if before is None:
            retracted = folded.limit(0)
            self._write(folded, "incidents", version)
        else:
            at = again.select("region", F.col("id").alias("incident"))
            replaced = before.join(at, ["region", "incident"], "left_semi").select(*folded.columns)
            self._write(before.join(at, ["region", "incident"], "left_anti").select(*folded.columns).unionByName(folded), "incidents", version)
            retracted, folded = replaced.exceptAll(folded), folded.exceptAll(replaced)
        self._write(retracted.select(F.lit("retract").alias("change"), "*").unionByName(folded.select(F.lit("put").alias("change"), "*")), "changes", version)
        over = grouped.groupBy("region", "_group").agg(F.max("t").alias("t")).where(F.col("t") < (latest if latest is not None else 0.0) - self.keep_s - self.remember_s)
        let_go = grouped.join(over.select("region", "_group"), ["region", "_group"], "left_semi").select("region", "id")
        self._write(work.join(let_go, ["region", "id"], "left_anti"), "reports", version)
        at, files = self._files(f"{self.path}/marks/{version}")
        files.create(at, True).close()
        for old in done[:-1]:  # the version before stays for its readers
            for what in ("incidents", "reports", "groups", "folded", "arrived"):
                files.delete(self._files(f"{self.path}/{what}/version={old}")[0], True)
