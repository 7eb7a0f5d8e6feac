"""Shared plumbing of the training-data operators: tables, scratch space, safe lookups."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import weakref
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only after its row count was measured and is no larger than this.
MAX_BROADCAST_ROWS = 200_000
#: Documents may be long, so a batch to a Python worker has at most so many rows and, of these, bytes.
ARROW_ROWS, ARROW_BYTES = 1_000, 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_importable(spark: SparkSession) -> None:
    """Python workers resolve this package by name, wherever the driver was started, and get bounded batches.

    Called by every operator that has work for Python workers. The bounds stay set in the session.
    """
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for key, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.fullmatch(r"(-?\d+)b?", spark.conf.get(key))
        if now and not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset: on one machine a
    temporary folder, on a cluster an error, as its machines would not see each other's files."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        named = given.get()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = Path(tempfile.mkdtemp(prefix="tracewright-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Scratch:
    """Tables written into the shared folder to cut lineage; they survive lost executors.

    ``owner`` groups tables, so a pipeline can drop those of a stage once its result is written.
    """

    live: dict[str, list[tuple[SparkSession, str]]] = {}
    places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()

    @classmethod
    def path(cls, spark: SparkSession, owner: str, label: str) -> str:
        path = f"{shared_dir(spark)}/tracewright/{owner}-{label}-{uuid.uuid4().hex}"
        cls.live.setdefault(owner, []).append((spark, path))
        return path

    @classmethod
    def write(cls, df: DataFrame, owner: str, label: str) -> DataFrame:
        spark = df.sparkSession
        path = cls.path(spark, owner, label)
        df.write.option("compression", "zstd").parquet(path)
        cls.places[back := spark.read.schema(df.schema).parquet(path)] = path
        return back

    @classmethod
    def free(cls, *tables: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for df in tables:
            cls.delete(df.sparkSession, cls.places.pop(df))

    @staticmethod
    def delete(spark: SparkSession, path: str) -> None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    @classmethod
    def drop(cls, owner: str) -> None:
        for spark, path in cls.live.pop(owner, []):
            try:
                cls.delete(spark, path)
            except Exception:  # the session has gone; its folder goes with the cluster's clean-up
                return


@atexit.register
def _drop_all() -> None:
    for owner in list(Scratch.live):
        Scratch.drop(owner)


def lookup_join(df: DataFrame, dim: DataFrame, on: list[str], rows: int | None = None) -> DataFrame:
    """Left join; the dimension is broadcast only when its measured size allows, else AQE shuffles and splits skew."""
    n = dim.count() if rows is None else rows
    return df.join(F.broadcast(dim) if n <= MAX_BROADCAST_ROWS else dim, on, "left")


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; extra columns, whatever their names, do not take part."""
    return df.select(*[df[f"`{n}`"] for n in names])


def having(df: DataFrame, ids: DataFrame, on: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join; the ids are broadcast only when their measured number allows."""
    return df.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_ROWS else ids, on, how)
