"""A time limit for the jobs of one query."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, Row

CHECK_SECONDS = 0.2


def fetch(df: DataFrame, seconds: float) -> list[Row]:
    """The rows of a query; its jobs are cancelled when the time is over (``TimeoutError``).

    A job tag marks the jobs of the calling thread. Cancelling is repeated until the query has ended, since a query may
    submit further jobs between two stages.
    """
    context = df.sparkSession.sparkContext
    tag = f"query-{uuid.uuid4().hex}"
    ended, expired = threading.Event(), threading.Event()

    def watch() -> None:
        if ended.wait(seconds):
            return
        expired.set()
        while not ended.is_set():
            context.cancelJobsWithTag(tag)
            ended.wait(CHECK_SECONDS)

    watcher = threading.Thread(target=watch, daemon=True)
    context.addJobTag(tag)
    watcher.start()
    try:
        return df.collect()
    except Exception as problem:
        if expired.is_set():
            raise TimeoutError(f"Query exceeded {seconds} second timeout") from problem
        raise
    finally:
        ended.set()
        watcher.join()
        context.removeJobTag(tag)
