"""Running stages in order with markers, retries and errors as values."""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from interlock.session import exists, read_text, remove, write_text

LOG = logging.getLogger("interlock")


def retry(times: int = 3, delay: float = 1.0, backoff: float = 2.0, errors: tuple[type[BaseException], ...] = (Exception,)) -> Callable:
    """Call again after an error, waiting longer each time; the last error is raised.  For driver calls: tasks are retried by Spark."""

    def wrap(f: Callable) -> Callable:
        @wraps(f)
        def run(*args: Any, **kwargs: Any) -> Any:
            wait = delay
            for k in range(times):
                try:
                    return f(*args, **kwargs)
                except errors:
                    if k == times - 1:
                        raise
                    time.sleep(wait)
                    wait *= backoff

        return run

    return wrap


def attempted(f: Callable, *args: Any, default: Any = None, **kwargs: Any) -> tuple[Any, str | None]:
    """(result, None), or (default, the error's text)."""
    try:
        return f(*args, **kwargs), None
    except Exception as e:
        LOG.warning("%s failed: %s", getattr(f, "__name__", f), e)
        return default, str(e)


class Marker:
    """How far a run has come, in a small file of the folder's own file system, so that a driver started elsewhere finds it."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.file = spark, f"{folder}/stage.json"

    def save(self, step: int, data: Any = None) -> None:
        self.clear()
        write_text(self.spark, self.file, json.dumps({"step": step, "data": data}))

    def load(self) -> tuple[int, Any]:
        if not exists(self.spark, self.file):
            return 0, None
        v = json.loads(read_text(self.spark, self.file))
        return v["step"], v["data"]

    def clear(self) -> None:
        remove(self.spark, self.file)

    def is_done(self, step: int) -> bool:
        return self.load()[0] >= step


class Pipeline:
    """Named stages, each a function of the tables before it to a table, written once under a folder.

    A stage whose table is there is read, not run again; ``start_at`` forces it and all later ones, ``stop_before`` ends early.
    """

    def __init__(self, spark: SparkSession, folder: str, stages: list[tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]) -> None:
        self.spark, self.folder, self.stages = spark, folder, stages

    def run(self, start_at: str | None = None, stop_before: str | None = None) -> dict[str, DataFrame]:
        tables: dict[str, DataFrame] = {}
        forced = False
        for name, f in self.stages:
            if name == stop_before:
                break
            forced |= name == start_at
            at = f"{self.folder}/{name}"
            if forced or not exists(self.spark, f"{at}/_SUCCESS"):
                began = time.time()
                f(tables).write.mode("overwrite").parquet(at)
                LOG.info("%s took %.1f s", name, time.time() - began)
                forced = True
            tables[name] = self.spark.read.parquet(at)
        return tables
