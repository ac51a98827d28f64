"""Storage between jobs: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Texts in a batch for Python workers.
BATCH_ROWS = 500

_shipped: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where the session names none (tests, a single machine) one is made and set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        local = tempfile.mkdtemp(prefix="tabscope-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        folder = f"file://{local}"
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Ready a session for functions in Python workers.

    They get at most ``BATCH_ROWS`` texts at once, so that their memory doesn't hang on
    the table, and this package, wherever the driver has it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    context = spark.sparkContext
    if _shipped.get("to") != context.applicationId:
        package = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="tabscope-")  # the driver serves the file from here
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = Path(folder) / f"tabscope-{uuid.uuid4().hex}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(package.rglob("*.py")):
                z.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _shipped["to"] = context.applicationId


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` hasn't, upper and lower case alike."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` but for those named, upper and lower case alike."""
    gone = {n.lower() for n in names}
    return [F.col(quoted(c)) for c in df.columns if c.lower() not in gone]


def with_results(df: DataFrame, found: Column, names: tuple[str, ...]) -> DataFrame:
    """``df`` with the named fields of the struct ``found`` as columns.

    Columns of ``df`` that have the name of a result give way to it; all others stay.
    """
    own = unused(df, "found")
    return df.withColumn(own, found).select(*without(df, *names), *[F.col(own)[n].alias(n) for n in names])


#: Bits of a key filter.  Its size is fixed; a fuller filter only lets more keys pass.
FILTER_BITS = 1 << 23


def key_filter(places: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """Bits set at the values of the one column, each in [0, size)."""
    place = F.col(places.columns[0])
    parts = (
        places.groupBy(F.shiftright(place, 15).alias("part"))
        .agg(F.bitmap_construct_agg(place.bitwiseAND(32767)).alias("bits"))
        .collect()  # size / 32768 rows at most
    )
    bits = np.zeros(size // 8, np.uint8)
    for r in parts:
        bits[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["bits"], np.uint8)
    return bits


def passing(bits: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places the filter has."""
    return (bits[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


class Scratch:
    """Tables of one operator run in the shared folder.

    ``keep`` cuts the lineage: it writes a frame as Parquet and reads it back, so a
    lost executor costs no recomputation of what came before.  ``drop`` deletes a
    table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, table: str, compression: str = "snappy") -> DataFrame:
        path = f"{self.root}/{table}"
        df.write.parquet(path, compression=compression)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
            conf = self.spark.sparkContext._jsc.hadoopConfiguration()
            path.getFileSystem(conf).delete(path, True)
