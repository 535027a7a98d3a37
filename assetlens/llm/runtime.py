"""Shared folder handling for the training-data operators.

Intermediate tables are written as Parquet below ``spark.checkpoint.dir`` and reread. That cuts the
lineage, so a lost executor never forces an upstream recomputation that could differ, and it is the one
folder that the driver and all executors are promised to share.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONF = "spark.checkpoint.dir"
ARROW_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by the session; a temporary one is set only where none is named (tests)."""
    found = spark.conf.get(_CONF, None) or spark.sparkContext.getConf().get(_CONF)
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="assetlens-")
        spark.conf.set(_CONF, found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/assetlens/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the table reread from there.

    The written query's shuffle files are of no use any more; a collection of the driver's garbage lets Spark drop them
    from the executors' disks now rather than at some later collection.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


_STATE: dict = {}


def worker_state(key, make):
    """What an operator keeps in a Python worker from task to task: one operator's at a time, so that their sizes never add up."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = make()
    return _STATE[key]


def enter() -> None:
    """A task of an operator that keeps nothing begins: what another one kept goes."""
    _STATE.clear()


def leave() -> None:
    """Give memory that a task has freed back to the system, which allocators else keep for a worker's whole life."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)


def tidy(f):
    """The function of a Python stage, with ``enter`` before and ``leave`` behind it."""

    def run(batches):
        from assetlens.llm import runtime  # by name, as a copy of this function would have a state of its own

        runtime.enter()
        try:
            yield from f(batches)
        finally:
            runtime.leave()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that the operators need; other columns never clash with work columns. Null text is empty.

    The session's Arrow batches are held to ARROW_BYTES from here on, so that a worker's memory follows from that or from
    one longer text, and not from how many rows 10,000 texts of any length make.
    """
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(name: str, taken: list[str]) -> str:
    """A column name that none of those taken equals, whatever its case."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def split_by_bitmap(docs: DataFrame, key: Column, has) -> tuple[DataFrame, DataFrame]:
    """(rows whose 64-bit key may be among some, rows whose key surely is not), all columns kept, nothing shuffled.

    ``has`` tells for an array of keys whether each may be. Null keys are surely not.
    """
    import pyarrow as pa

    name = free_name("key", docs.columns)

    def half(wanted: bool):
        def batches(arrow):
            for batch in arrow:
                keys = batch.column(batch.num_columns - 1)
                found = has(keys.fill_null(0).to_numpy(zero_copy_only=False)) & keys.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(batch.columns[:-1], names=batch.schema.names[:-1]).filter(pa.array(found == wanted))

        return docs.select("*", key.cast("long").alias(name)).mapInArrow(tidy(batches), docs.schema)

    return half(True), half(False)
