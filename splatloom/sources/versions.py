"""A table of versions: one written snapshot for each step, committed once."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """Snapshots in a folder that all executors share, ``step=<n>`` each; a snapshot counts once Spark has committed it.

    A commit of a step that is there already changes nothing, so a driver that starts again replays its steps without
    effect; what a broken write left behind is overwritten.  One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _files(self, pattern: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{pattern}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return files, [f.getPath() for f in files.globStatus(path) or []]

    def steps(self) -> list[int]:
        """The committed steps in ascending order."""
        return sorted(int(p.getParent().getName().removeprefix("step=")) for p in self._files("step=*/_SUCCESS")[1])

    def at(self, step: int) -> DataFrame:
        """The snapshot of a committed step."""
        if step not in self.steps():
            raise KeyError(f"no step {step} in {self.folder}")
        return self.spark.read.parquet(f"{self.folder}/step={step}")

    def latest(self) -> tuple[int, DataFrame]:
        """(step, snapshot) of the last committed step."""
        steps = self.steps()
        if not steps:
            raise KeyError(f"no step in {self.folder}")
        return steps[-1], self.at(steps[-1])

    def commit(self, step: int, make: Callable[[DataFrame | None], DataFrame]) -> bool:
        """Write what ``make`` makes of the step before as ``step``; False, without a call of ``make``, if it is there already."""
        known = self.steps()
        if step in known:
            return False
        if known and step < known[-1]:
            raise ValueError(f"step {step} is older than the last one, {known[-1]}; roll back first")
        make(self.at(known[-1]) if known else None).write.mode("overwrite").parquet(f"{self.folder}/step={step}")
        return True

    def rollback(self, step: int) -> list[int]:
        """Remove all steps after ``step``, the last first, and give them back; each goes out of sight at once, before its files go."""
        gone = []
        for later in sorted((s for s in self.steps() if s > step), reverse=True):
            files, found = self._files(f"step={later}")
            away = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/removed-{later}-{uuid.uuid4().hex}")
            files.rename(found[0], away)
            files.delete(away, True)
            gone.append(later)
        return gone
