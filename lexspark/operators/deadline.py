"""Spark work with a time limit: the jobs of a call bear a tag and are cancelled when the time is over."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")


def within(spark: SparkSession, seconds: float, call: Callable[[], T]) -> T:
    """What call() gives, if it does within so many seconds, else TimeoutError. The jobs that it runs are then cancelled, and so is
    every job that it starts later, until it ends by itself; an error of the call is raised here."""
    sc, tag = spark.sparkContext, f"within-{uuid.uuid4().hex}"
    done: dict[str, object] = {}

    def run() -> None:
        sc.addJobTag(tag)  # tags belong to the thread
        sc.setInterruptOnCancel(True)
        try:
            done["value"] = call()
        except BaseException as error:
            done["error"] = error
        finally:
            sc.removeJobTag(tag)

    worker = threading.Thread(target=run, daemon=True)
    worker.start()
    worker.join(seconds)
    if worker.is_alive():

        def reap() -> None:
            while worker.is_alive():
                sc.cancelJobsWithTag(tag)
                worker.join(0.1)

        sc.cancelJobsWithTag(tag)
        threading.Thread(target=reap, daemon=True).start()
        raise TimeoutError(f"no answer within {seconds} seconds")
    if "error" in done:
        raise done["error"]
    return done["value"]
