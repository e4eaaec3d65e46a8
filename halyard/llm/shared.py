"""Tables written to the folder that all machines of a session share, and filters in front of joins."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from halyard.session import ship


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Where it is unset a local master gets a folder of its own (tests); on a
    cluster a machine-local folder would lose rows, so that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = tempfile.mkdtemp(prefix="halyard-checkpoints-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def bounded_batches(spark: SparkSession, size: str = "2m") -> None:
    """Send the package, and let no Arrow batch to Python be much larger than ``size``: a worker holds few texts at a time.

    The setting stays with the session, as results are lazy and run under it.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def _path(spark: SparkSession, where: str):
    return spark._jvm.org.apache.hadoop.fs.Path(where)


def drop(spark: SparkSession, where: str) -> None:
    """Delete a table that no plan reads any more."""
    path = _path(spark, where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Tables that live until the driver ends, since lazy results may read them.
_WRITTEN: list[tuple[SparkSession, str]] = []


def _drop_all() -> None:
    for spark, where in _WRITTEN:
        with contextlib.suppress(Exception):  # the JVM may have gone first
            drop(spark, where)


def cut(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    where = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_drop_all)
    _WRITTEN.append((spark, where))
    df.write.option("compression", "zstd").parquet(where)
    return spark.read.schema(df.schema).parquet(where), where


def table(df: DataFrame, name: str) -> DataFrame:
    return cut(df, name)[0]


def settled(build: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``build`` returns, written; the tables that were written on the way there are dropped, as nothing reads them any more."""
    before = len(_WRITTEN)
    out, where = cut(build(), name)
    for spark, path in _WRITTEN[before:]:
        if path != where:
            drop(spark, path)
    _WRITTEN[before:] = [(out.sparkSession, where)]
    return out


def free(names: list[str], *wanted: str) -> list[str]:
    """Column names like ``wanted`` that a caller's table does not hold, whatever the case of its letters."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = f"_{w}"
        taken.add(w.lower())
        out.append(w)
    return out


_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class KeyFilter:
    """A Bloom filter of long keys that tasks read; it never says no to a key that it was built from.

    Its size follows the number of keys up to ``most_bits``.  For more keys
    than a filter of that size tells apart none is built, and all rows pass.
    """

    def __init__(self, keys: DataFrame, key: str, most_bits: int = 1 << 25):
        count = keys.count()
        self.bits = min(most_bits, 1 << max(10, (12 * count).bit_length()))
        self.sent: Broadcast | None = None
        if count > most_bits // 2:
            return
        bits, places = self.bits, self._places

        def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = np.zeros(bits // 8, np.uint8)
            for batch in it:
                for at in places(batch.column(0).to_numpy(zero_copy_only=False)):
                    np.bitwise_or.at(part, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))
            yield pa.RecordBatch.from_arrays([pa.array([part.tobytes()], pa.binary())], ["part"])

        total = np.zeros(bits // 8, np.uint8)
        for row in keys.select(F.col(key).alias("k")).coalesce(4).mapInArrow(tidy(fill), "part binary").toLocalIterator():
            total |= np.frombuffer(row["part"], np.uint8)
        self.sent = keys.sparkSession.sparkContext.broadcast(total.tobytes())

    def _places(self, keys: np.ndarray) -> list[np.ndarray]:
        k = keys.astype(np.int64, copy=False).view(np.uint64)
        return [(k * np.uint64(c) >> np.uint64(20)) & np.uint64(self.bits - 1) for c in _ODD]

    def __getstate__(self) -> dict:
        return {"bits": self.bits, "sent": self.sent}

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        if self.sent is None:
            return found
        held = np.frombuffer(self.sent.value, np.uint8)
        for at in self._places(keys):
            found &= (held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        return found

    def column(self, key: Column) -> Column:
        """Whether a long column, not null, may be among the keys."""

        @F.arrow_udf("boolean")
        def maybe(keys: pa.Array) -> pa.Array:
            return pa.array(self.may_hold(keys.to_numpy(zero_copy_only=False)))

        return maybe(key)


#: A key with more rows than this is hot: its rows are not shuffled to one task.
HOT = 20_000
#: So many hot keys are sent out at most.
MOST_HOT = 200_000


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, count: str, written: bool = False) -> DataFrame:
    """``rows`` joined with ``per_key`` (key, count, ...) on ``key``, without ``count``.

    ``per_key`` has a row for each key and the number of rows that hold it.
    The keys of more than HOT rows, few by that, are broadcast, so their rows
    stay where they are; the others meet by a shuffle.  If there are more than
    MOST_HOT such keys (over 4e9 rows) the engine's own skew joins serve.
    per_key is written first, as it is read more than once; or the caller has.
    """
    per_key = per_key if written else table(per_key, "per_key")
    hot = per_key.filter(F.col(count) > HOT)
    n = hot.limit(MOST_HOT + 1).count()
    if not 0 < n <= MOST_HOT:
        return rows.join(per_key.drop(count), key)
    sent = F.broadcast(hot.drop(count))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(per_key.filter(F.col(count) <= HOT).drop(count), key)
    return rows.join(sent, key).unionByName(cold)


#: What a worker forgets when it rests: memos that only save time.
FORGOTTEN: list[Callable[[], None]] = []
_REST_S = 2.0
_rest: list[threading.Timer] = []


def _forget() -> None:
    for f in FORGOTTEN:
        f()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for a worker that gives back its memory once it has had no task for a while.

    Workers outlive their tasks, and those of an earlier stage wait beside
    those of a later one.
    """

    def tidied(it: Iterator) -> Iterator:
        while _rest:
            _rest.pop().cancel()
        pa.set_memory_pool(pa.system_memory_pool())  # the one that trimming reaches
        try:
            yield from run(it)
        finally:
            timer = threading.Timer(_REST_S, _forget)
            timer.daemon = True
            _rest.append(timer)
            timer.start()

    return tidied


def map_texts(docs: DataFrame, keep: list[str], make: Callable[[list], list[pa.Array]], made: str, names: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns, which Python hands on as they came, and the columns ``made`` that ``make`` builds from the texts of a batch.

    ``names`` are those of the columns made, where the schema nests.
    """
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), made])
    all_ = [*keep, *(names or (x.split()[0] for x in made.split(", ")))]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, *make(batch.column(len(keep)).to_pylist())], all_)

    return docs.select(*keep, "text").mapInArrow(tidy(run), schema)
