"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

ROOT = str(Path(__file__).resolve().parent.parent)


def build(app: str = "plumbline", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the operators assume: UTC, ANSI, AQE with skew handling."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    return builder.config(map=settings | (conf or {})).getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir.

    Where that is unset a session on one machine gets a temporary folder, the same at each call and removed
    when Python ends; on a cluster it's an error, since the executors wouldn't see it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def scratch(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that no other call gets."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of the shared one, files and all; one that isn't there is no error."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a finished action go at once instead of with the driver's next collection of garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """`rows` by the hash of their keys in as many partitions as the session shuffles into; few bytes that mean much work aren't put together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def pieces(session: SparkSession, rows: int, piece: int) -> int:
    """As many partitions as the session shuffles into, and more where these would hold over `piece` rows each."""
    return max(int(session.conf.get("spark.sql.shuffle.partitions")), -(-rows // piece))


def in_groups(rows: DataFrame, key: str, order: str, one: Callable[[list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """`one` over the rows of each key in order, as tuples of the columns: like applyInPandas, for many small groups.

    A task streams through its sorted rows and holds one group at a time, without a data frame for each.
    """
    importable(rows.sparkSession)
    names = rows.columns
    at = names.index(key)
    types = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(k).to_pylist() for k in range(len(names))), strict=True):
                if group and group[0][at] != row[at]:
                    out += one(group)
                    group = []
                group.append(row)
            yield packed(out)
        if group:
            yield packed(one(group))

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(types)], schema=types)

    return dealt(rows, key).sortWithinPartitions(key, order).mapInArrow(run, schema)


def shuffled(df: DataFrame) -> DataFrame:
    """`df` for a join that never broadcasts it: Spark's size estimate misses rows that explode, Python or a checkpoint bring."""
    return df.hint("merge")


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage.

    An executor that is lost takes nothing with it: what was written stays.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
