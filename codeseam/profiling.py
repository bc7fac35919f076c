"""Wall clock and Spark's own counters of actions, and how far a job is."""

from __future__ import annotations

import functools
import time
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession


@dataclass
class Sample:
    name: str
    seconds: float
    failed: bool = False


SAMPLES: list[Sample] = []


def profiled(function):
    """Notes how long each call of a function takes, also of one that fails; lazy frames cost what their action costs."""

    @functools.wraps(function)
    def timed(*args, **options):
        began, failed = time.perf_counter(), True
        try:
            out = function(*args, **options)
            failed = False
            return out
        finally:
            SAMPLES.append(Sample(function.__name__, time.perf_counter() - began, failed))

    return timed


def samples(spark: SparkSession):
    """The samples as a frame (name, seconds, failed), for stats.profile and stats.benchmark."""
    return spark.createDataFrame([tuple(asdict(s).values()) for s in SAMPLES], "name string, seconds double, failed boolean")


def progress(spark: SparkSession, group: str) -> dict:
    """Tasks done and all tasks of the jobs of a group so far, and the share in percent."""
    tracker = spark.sparkContext.statusTracker()
    done = total = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            s = tracker.getStageInfo(stage)
            if s:
                done, total = done + s.numCompletedTasks, total + s.numTasks
    return {"done": done, "total": total, "progress": 100 * done // total if total else 0}
