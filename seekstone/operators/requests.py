"""Searches of which only the latest counts: a newer one ends the jobs of the one before."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession


class Latest:
    """Runs one request after another for a caller who only wants the newest answer.

    Every request has a number and tags its jobs; a newer request cancels them, on the executors too.
    A request that is no longer the newest gives None, whether its jobs were ended or had just ended by
    themselves: never a part of its rows, and never rows after a newer request began.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.lock, self.number, self.tag = spark, threading.Lock(), 0, None

    def _next(self, tag: str | None) -> int:
        with self.lock:
            self.number += 1
            old, self.tag = self.tag, tag
            number = self.number
        if old is not None:
            self.spark.sparkContext.cancelJobsWithTag(old)
        return number

    def _is_latest(self, number: int) -> bool:
        with self.lock:
            return number == self.number

    def cancel(self) -> None:
        """End what runs, without another request."""
        self._next(None)

    def run(self, search: Callable[[], DataFrame]) -> list[Row] | None:
        """The rows of ``search()``, or None where a newer request or ``cancel`` came before they were there.

        Plans are made within the request too, since a search may run jobs to make its plan.
        """
        context, tag = self.spark.sparkContext, f"latest-{uuid.uuid4().hex}"
        number = self._next(tag)
        context.addJobTag(tag)
        try:
            frame = search()
            rows = frame.collect() if self._is_latest(number) else None
        except Exception:
            if self._is_latest(number):
                raise
            return None
        finally:
            context.removeJobTag(tag)
        return rows if self._is_latest(number) else None
