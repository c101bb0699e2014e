"""Extension points: named functions, job kinds, a bounded cache of named frames, timers."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Routine:
    name: str
    call: Callable
    least: int
    most: int
    help: str = ""


class Routines:
    """Functions by name with their arity; ``register`` makes them SQL functions too."""

    def __init__(self) -> None:
        self.known: dict[str, Routine] = {}

    def add(self, name: str, call: Callable, least: int, most: int | None = None, help: str = "") -> None:  # noqa: A002
        self.known[name.upper()] = Routine(name.upper(), call, least, least if most is None else most, help)

    def __call__(self, name: str, *args):
        r = self.known[name.upper()]
        if not r.least <= len(args) <= r.most:
            raise TypeError(f"{r.name} takes {r.least} to {r.most} arguments")
        return r.call(*args)

    def info(self) -> Iterator[tuple[str, str]]:
        return ((r.name, r.help) for r in sorted(self.known.values(), key=lambda r: r.name))

    def register(self, spark: SparkSession, name: str, kind: str) -> None:
        spark.udf.register(name.lower(), self.known[name.upper()].call, kind)


class Jobs:
    """Kinds of jobs by tag: each makes a job from its configuration."""

    def __init__(self) -> None:
        self.makers: dict[str, Callable] = {}

    def register(self, tag: str, maker: Callable) -> None:
        self.makers[tag.lower()] = maker

    def new(self, tag: str, *args):
        if tag.lower() not in self.makers:
            raise KeyError(f"no job of kind {tag!r}")
        return self.makers[tag.lower()](*args)


class Job:
    """A job as three parts: split into rows, run on each group of rows, merge what comes back."""

    key: str = "part_id"
    schema: str = ""

    def split(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def run(self, pdf):
        raise NotImplementedError

    def merge(self, parts: DataFrame) -> DataFrame:
        return parts

    def result(self, spark: SparkSession) -> DataFrame:
        run = self.run
        return self.merge(self.split(spark).groupBy(self.key).applyInPandas(lambda pdf: run(pdf), self.schema))


class FrameCache:
    """Named frames kept on disk and in memory by Spark: put, get, delete, store, load, clear, info."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.frames = spark, {}

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.delete(name)
        self.frames[name] = df.persist(StorageLevel.MEMORY_AND_DISK)
        return self.frames[name]

    def get(self, name: str, otherwise: Callable[[], DataFrame] | None = None) -> DataFrame:
        if name not in self.frames and otherwise is not None:
            return self.put(name, otherwise())
        return self.frames[name]

    def delete(self, name: str) -> bool:
        df = self.frames.pop(name, None)
        if df is not None:
            df.unpersist()
        return df is not None

    def store(self, name: str, path: str) -> None:
        self.frames[name].write.mode("overwrite").parquet(path)

    def load(self, name: str, path: str) -> DataFrame:
        return self.put(name, self.spark.read.parquet(path))

    def clear(self) -> None:
        for name in list(self.frames):
            self.delete(name)

    def info(self) -> dict[str, str]:
        return {name: df.schema.simpleString() for name, df in self.frames.items()}


@dataclass
class StopWatch:
    """Wall and CPU seconds since ``tic``."""

    wall: float = field(default_factory=time.perf_counter)
    cpu: float = field(default_factory=time.process_time)

    def tic(self) -> None:
        self.wall, self.cpu = time.perf_counter(), time.process_time()

    def toc(self) -> tuple[float, float]:
        return time.perf_counter() - self.wall, time.process_time() - self.cpu


def part_timeout(longest: float, progress: float) -> float:
    """Seconds after which a part is given out again: from 20 times the longest part at the start to 5 times at the end."""
    return longest * (20 - 15 * progress)
