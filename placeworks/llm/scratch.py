"""Lineage cuts: intermediate tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Rows of texts that go to a Python worker at once.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bound(spark: SparkSession) -> str:
    now = spark.conf.get(_BATCH)
    if not 0 < int(now) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
    return now


def bounded(query: Callable[..., Any]) -> Callable[..., Any]:
    """query(spark, ...), whose session sends BATCH_ROWS rows at most to a Python worker at once, from then on."""

    @wraps(query)
    def run(spark: SparkSession, *args: Any, **named: Any) -> Any:
        _bound(spark)
        return query(spark, *args, **named)

    return run


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """BATCH_ROWS rows at most go to a Python worker at once."""
    now = _bound(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, now)


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, a temporary one of this machine, which only a local master can use."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not hasattr(shared_dir, "own"):
        shared_dir.own = "file://" + tempfile.mkdtemp(prefix="llm-tables-")
    return shared_dir.own


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table written to the shared folder and read again.

    The plan behind it is computed once, and a lost executor costs only the
    tasks that were running: whatever reads the table starts from its files.
    """
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
