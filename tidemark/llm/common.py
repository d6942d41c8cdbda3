"""Shared pieces: table access, byte-level word splitting, worker-held caches."""

from __future__ import annotations

import ctypes
import pickle
import sys
import threading
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str, folds: int, fold: int) -> Column:
    """True for rows whose crc32 of the key as text falls in the fold; a null key is never held out."""
    crc = F.crc32(F.encode(F.col(key).cast("string"), "UTF-8"))
    return F.coalesce(crc % folds == fold, F.lit(False))


def _lower(keep) -> bytes:
    """A bytes.translate table: A-Z lower-cased, then bytes that keep() rejects turned to spaces."""
    out = bytearray()
    for b in range(256):
        b = b + 32 if 0x41 <= b <= 0x5A else b
        out.append(b if keep(b) else 0x20)
    return bytes(out)


#: Words of digits, a-z and everything beyond ASCII.
WORDS = _lower(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: Words of everything but ASCII white space, which bytes.split() takes as separators.
TOKENS = _lower(lambda b: True)


def split(text: str | None, how: bytes) -> list[bytes]:
    """The words of a whole text; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(how).split() if text else []


#: Seconds without a task after which a Python worker gives its memory back.
IDLE = 1.0


def worker_cache(owner: str, name: str, make: Callable[[], object]):
    """A value that a Python worker keeps between its tasks; losing it only costs time.

    It is kept on sys, since modules that travel by value are made anew for each task.
    The owner is the operator's module. Values of another owner, the operator that the
    worker served before, are dropped; so are all of them when the worker has no task.
    """
    held = sys.__dict__.setdefault("_tidemark_held", {})
    if (mine := held.get(owner)) is None:
        held.clear()
        mine = held[owner] = {}
    if (value := mine.get(name)) is None:
        value = mine[name] = make()
    return value


def _drop_caches() -> None:
    """Drops what worker_cache holds; freed memory goes back to the system, where the C library can do that."""
    sys.__dict__.get("_tidemark_held", {}).clear()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def _begin_task(owner: str) -> None:
    if timer := sys.__dict__.pop("_tidemark_idle", None):
        timer.cancel()
    if sys.__dict__.get("_tidemark_held", {}).keys() - {owner}:
        _drop_caches()


def _end_task() -> None:
    """Spark keeps idle workers for as long as others of the executor have tasks."""
    pa.default_memory_pool().release_unused()
    timer = sys.__dict__["_tidemark_idle"] = threading.Timer(IDLE, _drop_caches)
    timer.daemon = True
    timer.start()


def share(spark: SparkSession, value) -> Callable[[], object]:
    """Broadcasts a value of bounded size; in a worker, calling the result gives the value.

    It travels as bytes with its classes inside, so workers need not import them.
    """
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, made the context's if it is not yet.

    A folder of this machine's own is set only where there is none and everything
    runs on this machine.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            import tempfile

            folder = tempfile.mkdtemp(prefix="checkpoints-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the cluster's checkpoint folder and read from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


#: Rows of a batch that are Python objects at once.
ROWS = 2000


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow where fn turns an iterator of column lists into one of column dicts."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    out = _parse_datatype_string(schema)
    assert isinstance(out, StructType)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)
    owner = fn.__module__.rpartition(".")[2]

    def run(batches):
        _begin_task(owner)
        lists = ([c.to_pylist() for c in b.slice(at, ROWS).columns] for b in batches for at in range(0, b.num_rows, ROWS))
        try:
            for made in fn(lists):
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)
        finally:
            _end_task()

    return df.mapInArrow(run, out)
