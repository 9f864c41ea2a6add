"""Stage control: order, done-guards, reset and resume of the construction, kept as small state files; preflight checks."""

from __future__ import annotations

import json
import shutil
import tempfile
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

STAGES = ("parse", "embed", "nodes", "leaf_edges", "word_vectors", "word_edges", "reentry", "triads", "extend", "layout")


class StageOrderError(RuntimeError):
    pass


@dataclass
class StageState:
    stage: str
    last_id: str | None = None
    processed: int = 0
    total: int = 0
    done: bool = False
    completed_at: float | None = None
    updated_at: float | None = None


class StageStore:
    """One JSON file per stage in a folder of any file system Spark reads, replaced by renaming."""

    def __init__(self, directory: str, spark: SparkSession):
        self.dir, self.jvm = directory.rstrip("/"), spark._jvm
        root = self.jvm.org.apache.hadoop.fs.Path(self.dir)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(root)

    def _path(self, stage: str, end: str = "json"):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.dir}/{stage}.{end}")

    def load(self, stage: str) -> StageState:
        if not self.fs.exists(self._path(stage)):
            return StageState(stage)
        f = self.fs.open(self._path(stage))
        try:
            return StageState(**json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(f, "UTF-8")))
        finally:
            f.close()

    def save(self, s: StageState) -> None:
        s.updated_at = time.time()
        f = self.fs.create(self._path(s.stage, "new"), True)
        try:
            f.write(bytearray(json.dumps(asdict(s)).encode()))
        finally:
            f.close()
        self.fs.delete(self._path(s.stage), False)
        self.fs.rename(self._path(s.stage, "new"), self._path(s.stage))

    def reset(self, stage: str) -> None:
        """Forget a stage and all that follow it."""
        for s in STAGES[STAGES.index(stage) :]:
            self.fs.delete(self._path(s), False)

    def begin(self, stage: str, force: bool = False, reset: bool = False) -> StageState | None:
        """The state to go on from, or None if the stage is done; raises if the stage before is not."""
        if stage not in STAGES:
            raise KeyError(stage)
        if reset:
            self.reset(stage)
        at = STAGES.index(stage)
        if at and not force and not self.load(STAGES[at - 1]).done:
            raise StageOrderError(f"{stage} needs {STAGES[at - 1]} first")
        s = self.load(stage)
        return None if s.done and not force else s

    def finish(self, s: StageState) -> None:
        s.done, s.completed_at = True, time.time()
        self.save(s)


def run_stage(store: StageStore, stage: str, work: Callable[[StageState], int], force: bool = False, reset: bool = False, dry_run: bool = False) -> int | None:
    """Run ``work`` under the guards; its result is the number processed. A dry run is not marked done; None: was done."""
    s = store.begin(stage, force, reset)
    if s is None:
        return None
    n = work(s)
    if not dry_run:
        s.processed = n
        store.finish(s)
    return n


def preflight(spark: SparkSession, inputs: list[str], directories: list[str], free_gb: float = 1.0) -> dict[str, bool]:
    """Checks before a build: the session answers, inputs can be read, directories are writable and have room."""
    out = {"session": spark.range(1).count() == 1}
    for p in inputs:
        try:
            out[f"input {p}"] = not spark.read.text(p).limit(1).isEmpty()
        except Exception:
            out[f"input {p}"] = False
    for d in directories:
        try:
            with tempfile.NamedTemporaryFile(dir=d):
                out[f"writable {d}"] = shutil.disk_usage(d).free > free_gb * 1e9
        except OSError:
            out[f"writable {d}"] = False
    return out
