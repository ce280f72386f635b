"""Stopping a translation from another thread, and watching the commit it is in."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

#: Told every few seconds: tasks done, and all tasks of the jobs that run just now.
Watcher = Callable[[int, int], None]


class Control:
    """A handle on one translation, batch or stream.

    Its Spark jobs carry a tag, so ``stop`` ends them wherever they are: within a commit
    as well as between two. What was committed stays, and the next run goes on from there.
    """

    def __init__(self, spark: SparkSession):
        self.context = spark.sparkContext
        self.tag = f"glossa-{uuid.uuid4().hex}"
        self._asked = threading.Event()
        self._streams: list[StreamingQuery] = []

    def asked(self) -> bool:
        return self._asked.is_set()

    def stop(self) -> None:
        self._asked.set()
        self.context.cancelJobsWithTag(self.tag)
        for query in self._streams:
            query.stop()

    def attach(self, query: StreamingQuery) -> StreamingQuery:
        self._streams.append(query)
        if self.asked():
            query.stop()
        return query

    @contextmanager
    def tagged(self) -> Iterator[None]:
        """Jobs that this thread starts inside belong to the translation."""
        self.context.addJobTag(self.tag)
        try:
            yield
        finally:
            self.context.removeJobTag(self.tag)

    def tasks(self) -> tuple[int, int]:
        """Tasks done and all tasks of the stages that the translation runs just now."""
        tracker = self.context._jsc.sc().statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForTag(self.tag):
            found = tracker.getJobInfo(job)
            if found.isEmpty() or str(found.get().status()) != "RUNNING":
                continue
            for stage in found.get().stageIds():
                info = tracker.getStageInfo(stage)
                if not info.isEmpty():
                    done += info.get().numCompletedTasks()
                    total += info.get().numTasks()
        return done, total

    @contextmanager
    def watched(self, watcher: Watcher | None, seconds: float = 2.0) -> Iterator[None]:
        """Tell ``watcher`` how far the running jobs are, as long as the block runs."""
        if watcher is None:
            yield
            return
        over = threading.Event()

        def look() -> None:
            while not over.wait(seconds):
                watcher(*self.tasks())

        thread = threading.Thread(target=look, daemon=True)
        thread.start()
        try:
            yield
        finally:
            over.set()
            thread.join()


def finished(query: StreamingQuery, control: Control) -> bool:
    """Wait for a stream: True when it came to its end, False when it was stopped."""
    try:
        query.awaitTermination()
    except StreamingQueryException:
        if not control.asked():
            raise
    return not control.asked()
