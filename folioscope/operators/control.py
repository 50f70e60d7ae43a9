"""Queries that can be stopped, and functions that others bring along."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession

PLUGINS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def run_stoppable(spark: SparkSession, tag: str, query: Callable[[], list]) -> list:
    """What ``query`` gives, or an empty list if ``stop`` is called with its tag meanwhile from another thread."""
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        return query()
    except Exception as e:
        if "cancelled" in str(e).lower() or "canceled" in str(e).lower():
            return []
        raise
    finally:
        context.removeJobTag(tag)


def stop(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(spark: SparkSession) -> dict[int, float]:
    """Share of tasks done, by active job."""
    tracker, out = spark.sparkContext.statusTracker(), {}
    for job in tracker.getActiveJobsIds():
        info = tracker.getJobInfo(job)
        stages = [x for x in map(tracker.getStageInfo, info.stageIds if info else []) if x]
        if total := sum(x.numTasks for x in stages):
            out[job] = sum(x.numCompletedTasks for x in stages) / total
    return out


class Watch:
    """Follows the jobs that run while it is open, from a thread beside them: for each stage, by its id, the share of its tasks that are done, as it rises.

    ``ratios`` has the shares seen so far, ``seen`` every stage's name and last share. It asks the driver, and moves no data.
    """

    def __init__(self, spark: SparkSession, every: float = 0.05, report: Callable[[int, str, float], None] | None = None):
        self.tracker, self.every, self.report = spark.sparkContext.statusTracker(), every, report
        self.ratios: dict[int, list[float]] = {}
        self.seen: dict[int, tuple[str, float]] = {}

    def _look(self) -> None:
        for k in {*self.tracker.getActiveStageIds(), *self.ratios}:
            info = self.tracker.getStageInfo(k)
            if info and info.numTasks:
                share = info.numCompletedTasks / info.numTasks
                if not self.ratios.get(k) or share > self.ratios[k][-1]:
                    self.ratios.setdefault(k, []).append(share)
                    self.seen[k] = (info.name, share)
                    if self.report:
                        self.report(k, info.name, share)

    def __enter__(self) -> Watch:
        import threading

        self.over = threading.Event()

        def follow() -> None:
            while not self.over.wait(self.every):
                self._look()

        self.thread = threading.Thread(target=follow, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()
        self._look()


def counted(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df``, and what tells after a run of it how many rows went through that place (``get["processed"]``): with the number of rows that there are, the ratio of an operation."""
    from pyspark.sql import functions as F

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("processed")), seen


def plugin(name: str) -> Callable:
    """Registers an operator, a function from DataFrame to DataFrame, by name; ``apply`` runs it. A name can't be taken twice."""

    def add(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        if name in PLUGINS:
            raise ValueError(f"there is a plugin {name} already")
        PLUGINS[name] = f
        return f

    return add


def apply(name: str, df: DataFrame) -> DataFrame:
    return df.transform(PLUGINS[name])


def matching(df: DataFrame, test: Column) -> DataFrame:
    """Rows that meet a condition given by the caller."""
    return df.where(test)


def without(df: DataFrame, test: Column) -> DataFrame:
    """Rows that don't; a condition that is null for a row leaves it."""
    from pyspark.sql import functions as F

    return df.where(~F.coalesce(test, F.lit(False)))
