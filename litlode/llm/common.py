"""Shared plumbing: checkpoints, bounded broadcasts, hot-key splitting, Arrow maps."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import zipfile
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a side that may be broadcast; the count is taken before the choice.
BROADCAST_ROWS = 200_000
#: Rows of one key that one task may hold before the key is split into cells.
CELL_ROWS = 4096


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder that the cluster names; in local mode, as in tests, set one where none is set.

    On a cluster without one this raises: executors would write to folders of their own.
    """
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        if not context.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="litlode-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder, so that a lost executor costs a reread only."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast if the (already materialised) side has at most ``bound`` rows.

    Beyond the bound the side is returned as it is, and Spark joins by a shuffle.
    """
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def keep_least(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` for each component of ``found(doc_id, text_hash, component)``, which is materialised.

    The row with the least id stays, null ids last, and of rows that share an id the one with the least
    text_hash, which is xxhash64 of the text. Survivors are marked by a grouped maximum, combined before its
    shuffle, so no task reads a component's rows, however many it has. The rows to drop are broadcast only if
    they are few; only rows that repeat a survivor are shuffled to leave one of them.
    """
    order = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_hash")
    first = found.groupBy("component").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_hash", F.lit(0).alias("rows"), F.lit(True).alias("stays"))
    marked = found.select("doc_id", "text_hash", F.lit(1).alias("rows"), F.lit(False).alias("stays")).union(first)
    pairs = cut(marked.groupBy(F.col("doc_id").alias("__litlode_id"), F.col("text_hash").alias("__litlode_hash")).agg(F.sum("rows").alias("count"), F.max("stays").alias("stays")))
    same = df[id_col].eqNullSafe(F.col("__litlode_id")) & (F.xxhash64(df[text_col]) == F.col("__litlode_hash"))
    drop = pairs.filter("not stays").select("__litlode_id", "__litlode_hash")
    twice = pairs.filter("stays and count > 1").select("__litlode_id", "__litlode_hash")
    if twice.isEmpty():
        return df.join(small_side(drop), same, "left_anti").select(*df.columns)
    once = df.join(small_side(drop.union(twice)), same, "left_anti").select(*df.columns)
    number = F.row_number().over(Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(F.lit(0)))
    repeated = df.join(small_side(twice), same, "left_semi").withColumn("__litlode_first", number).filter("__litlode_first = 1")
    return once.union(repeated.select(*df.columns))


_SHIPPED: set[str] = set()
#: Rows of an Arrow batch of texts, where the session has Spark's default: ten times as many fill a small executor.
BATCH_ROWS, _BATCH = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy() -> None:
    """Give memory that a worker has freed back to the system; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application: they may not share the driver's folders."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, BATCH_ROWS)
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="litlode-ship-")) / "litlode.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(package.rglob("*.py")):
                z.write(f, f"{package.name}/{f.relative_to(package)}")
        spark.sparkContext.addPyFile(str(target))
        _SHIPPED.add(app)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with the package at hand on the executors."""
    ship(df.sparkSession)

    def tidily(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(b for b in batches if b.num_rows)
        finally:
            tidy()

    return df.mapInArrow(tidily, schema)


def split_hot_keys(df: DataFrame, keys: Sequence[str], row_key: str, bound: int = CELL_ROWS) -> DataFrame:
    """Add ``part``, ``cell_a``, ``cell_b`` so that every two rows of a key meet in just one cell.

    A key of up to ``bound`` rows is one cell (0, 0). A larger key is dealt by a hash of
    ``row_key`` into c parts of about ``bound`` rows, and a row of part p goes to the cells
    {p, q} for all q: cell (p, p) compares inside the part, cell (p, q) across the two.
    A cell then has some 2 x bound rows, however many rows share the key.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).count().filter(F.col("count") > bound)
    parts = sizes.select(*keys, F.ceil(F.col("count") / F.lit(bound)).cast("int").alias("n_parts"))
    joined = df.join(parts, keys, "left").withColumn("n_parts", F.coalesce("n_parts", F.lit(1)))
    part = F.pmod(F.xxhash64(F.lit(17), F.col(row_key)), F.col("n_parts")).cast("int")
    return (
        joined.withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
        .withColumn("cell_a", F.least("part", "other"))
        .withColumn("cell_b", F.greatest("part", "other"))
        .drop("n_parts", "other")
    )


def grouped_batches(batches: Iterator[pa.RecordBatch], keys: Sequence[str], least: int = 8192) -> Iterator[pa.Table]:
    """From batches sorted by ``keys``, tables of at least ``least`` rows that end where a key ends.

    Memory is bounded by ``least``, one batch and the largest key, which split_hot_keys bounds.
    """
    keys = list(keys)
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        last = [whole.column(k)[n - 1].as_py() for k in keys]
        end = n
        mask = None
        for k, v in zip(keys, last, strict=True):
            same = pa.compute.equal(whole.column(k), pa.scalar(v, whole.schema.field(k).type))
            mask = same if mask is None else pa.compute.and_(mask, same)
        tail = pa.compute.sum(mask).as_py()
        end = n - tail
        if end:
            yield whole.slice(0, end)
        rest = whole.slice(end).combine_chunks()
        held, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()
