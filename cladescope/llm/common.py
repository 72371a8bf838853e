"""What the operators share: table access, shared-storage materialisation, word rules."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladescope.storage import shared_dir

#: A word is a maximal run of characters other than space, \t, \n, \v, \f and \r.
WORD = r"[^\x20\x09-\x0D]+"

#: Characters that separate words, for ``str.split`` replacements in Python code.
SEPARATORS = " \t\n\x0b\x0c\r"


#: Rows with long texts or sets go to Python in batches of this size, and are read so many at once.
_BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "spark.sql.parquet.columnarReaderBatchSize": "512"}
#: Writers hold row groups of this many bytes, and no least and largest values of columns; long values (see ``_long``) have no
#: dictionary, for which they would be copied. A Java process keeps the heap that it once took.
_WRITTEN = {"parquet.block.size": 16 << 20, "parquet.column.statistics.enabled": "false"}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; the session's batches are bounded from here on."""
    for k, v in _BATCH.items():
        spark.conf.set(k, v)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: While a table is written: a finished query's shuffle files go at once, and Arrow batches of long rows stay small.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", **_BATCH}


def _long(df: DataFrame) -> list[str]:
    """Columns of long values that hardly recur: texts and packed sets."""
    return [name for name, kind in df.dtypes if kind == "binary" or name == "text"]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it again.

    This cuts the lineage durably: a lost executor costs only its running tasks.
    Parquet keeps the table smaller than ``checkpoint()`` would, and the shuffle
    files that made it go, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in _WHILE}
    for k, v in _WHILE.items():
        spark.conf.set(k, v)
    try:
        df.write.options(**_WRITTEN, **{f"parquet.enable.dictionary#{name}": "false" for name in _long(df)}).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Delete written tables whose last reader is done; others than those of ``materialize`` are left alone."""
    for table in tables:
        if path := getattr(table, "shared_path", None):
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def lean(run: Callable) -> Callable:
    """``run`` for a worker that lives on: what its batches took goes back to the system at the end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return wrapped


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 = 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def n_words(text: Column) -> Column:
    """Words in the whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
