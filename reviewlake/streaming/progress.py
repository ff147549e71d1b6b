"""Reviews of whole directories as jobs, with stage and percent."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener

from reviewlake.operators.files import select_files
from reviewlake.operators.rules import explode_issues
from reviewlake.plans.review import review
from reviewlake.sources import tree
from reviewlake.sources.files import arrivals, listing, stream_files, stream_listed
from reviewlake.streaming.review import run_available

# --- Fixed values -----------------------------------------------------------
RUNNING_FROM, RUNNING_SHARE = 15, 75
PERCENT = {"queued": 0, "collecting": 10, "saving": 92, "completed": 100, "failed": 0}
# ----------------------------------------------------------------------------
REVIEWED = "reviewed"
#: Seconds that the end of a job waits for the last event of its query.
LAST_EVENT = 60


class Step(NamedTuple):
    stage: str
    done: int
    total: int
    percent: float


def running(done: int, total: int) -> Step:
    return Step("running", done, total, RUNNING_FROM + RUNNING_SHARE * min(done, total) / max(total, 1))


class Listener(StreamingQueryListener):
    """Turns the events of one named query into steps; counts are observed by the batches themselves."""

    def __init__(self, name: str, total: int, report: Callable[[Step], None]):
        self.name, self.total, self.report = name, total, report
        self.run_id, self.done, self.ended = None, 0, threading.Event()

    def onQueryStarted(self, event):
        if event.name == self.name:
            self.run_id = event.runId

    def onQueryProgress(self, event):
        seen = event.progress.observedMetrics.get(REVIEWED)
        if event.progress.runId == self.run_id and seen is not None and seen.files:
            self.done += seen.files
            self.report(running(self.done, self.total))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        if event.runId == self.run_id:
            self.ended.set()


def review_job(spark: SparkSession, root: str, out: str, checkpoint: str, report: Callable[[Step], None],
               project_id="project", files_per_batch: int = 1000, max_bytes: int | None = None, own=(), **options) -> None:
    """Review the files below ``root`` that no earlier run with this checkpoint has reviewed; write the findings to ``out``.

    ``report`` gets a step as the job is queued, collects, runs (one step a batch), saves
    and is completed.  ``total`` counts all files of the directory by a listing that opens none.
    The listing is kept in the checkpoint and is what is streamed: Spark's own reader lists every
    file of a batch once more, by a task each.  Stores that can't be walked are left to it.
    """
    at = lambda stage, done, total: report(Step(stage, done, total, float(PERCENT[stage])))
    at("queued", 0, 0)
    at("collecting", 0, 0)
    if tree.reachable(root):
        known = f"{checkpoint.rstrip('/')}/arrived"
        total = arrivals(spark, root, known, max_bytes, own, files_per_batch)
        arrived = stream_listed(spark, known, project_id, own) if tree.exists(spark, known) else None
    else:
        total = select_files(listing(spark, root, own), max_bytes, own).count()
        arrived = stream_files(spark, root, project_id, max_bytes, own, files_per_batch)
    if arrived is None:  # nothing has ever been there
        arrived = stream_files(spark, root, project_id, max_bytes, own, files_per_batch)
    listener = Listener(f"review-{uuid.uuid4().hex}", total, report)
    reviewed = review(arrived.observe(REVIEWED, F.count(F.lit(1)).alias("files")), own=own, **options)
    spark.streams.addListener(listener)
    try:
        run_available(explode_issues(reviewed, options.get("packs")), out, checkpoint, name=listener.name)
        listener.ended.wait(LAST_EVENT)
    except Exception:
        at("failed", listener.done, total)
        raise
    finally:
        spark.streams.removeListener(listener)
    at("saving", listener.done, total)
    at("completed", listener.done, total)


def as_rows(spark: SparkSession, steps: list[Step]) -> DataFrame:
    """Steps of a job, numbered: one row a batch."""
    rows = [(n, *s) for n, s in enumerate(steps)]
    return spark.createDataFrame(rows, "step int, stage string, done bigint, total bigint, percent double")
