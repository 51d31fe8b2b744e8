"""What the operators share: scratch tables on shared storage, and words of Arrow text columns."""

from __future__ import annotations

import ctypes
import hashlib
import pickle
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from types import ModuleType
from typing import Any

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper-case ASCII letters to lower case; all other bytes stay.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: ``bytes.split()`` cuts at exactly these bytes.
SPACE_BYTES = b" \t\n\r\x0b\x0c"
#: Second and later bytes of a UTF-8 character.
CONTINUATION = bytes(range(0x80, 0xC0))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder, which driver and executors both see.

    The folder is the session's ``spark.checkpoint.dir``, else the one set on the context; only where
    neither is set, as in tests on one machine, a temporary one is made and set. On a cluster that raises.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidings-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tidings-{name}-{uuid.uuid4().hex}"


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Jobs started within send Python workers at most ``rows`` rows at a time; whole texts are large rows."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, most = spark.conf.get(name, None), int(spark.conf.get(name))
    spark.conf.set(name, str(min(most, rows) if most > 0 else rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_folder(spark, name)
    with short_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; a null counts as the empty text."""
    return [v or b"" for v in column.cast(pa.large_binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Texts of a column; a null counts as the empty text."""
    return [v or "" for v in column.to_pylist()]


def give_back(*memories: Any) -> None:
    """Empty a task's memories at its end, and return what is free to the system.

    Python workers stay for later tasks; what one task remembered would otherwise stand beside the next's.
    """
    for memory in memories:
        memory.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def per_worker(name: str, make: Callable[[], Any]) -> Any:
    """A value that is made once in a Python worker and kept for its later tasks.

    Functions travel by value, so each task has module globals of its own; a module that the worker
    itself holds is shared by them. For read-only values of bounded size, as parsed vocabularies.
    """
    kept = sys.modules.setdefault("_kept_by_worker", ModuleType("_kept_by_worker"))
    if name not in vars(kept):
        setattr(kept, name, make())
        give_back()
    return getattr(kept, name)


def given_back(batches: Iterator[Any], *memories: Any) -> Iterator[Any]:
    """The batches of a task; when they are through, its memories are given back.

    What earlier tasks of the worker left free goes back first.
    """
    give_back()
    try:
        yield from batches
    finally:
        give_back(*memories)


def shipped(spark: SparkSession, value: Any) -> Broadcast:
    """Broadcast of an object with its class by value, for executors that lack this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def unpacked(sent: Broadcast) -> Any:
    """The object of ``shipped``."""
    return pickle.loads(sent.value)


def broadcast_file(spark: SparkSession, path: str) -> tuple[str, Broadcast]:
    """Digest and broadcast bytes of a vocabulary file (one fixed file of a few MB on the driver)."""
    with open(path, "rb") as handle:
        data = handle.read()
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)
