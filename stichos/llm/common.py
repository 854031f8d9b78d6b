"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_BYTES = 4 << 20
NULL_ID = -(1 << 63)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of whole texts are large: Arrow batches of the default number of rows would hold memory outside of the heap that
# nothing bounds. Set only where the session has Spark's default.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for an application, so that their Python workers can import it; bounds Arrow batches."""
    sc = spark.sparkContext
    for key, (default, value) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parent.parent
        folder = tempfile.mkdtemp(prefix="package-")                  # the driver serves it as long as it runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        archive = f"{folder}/{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in [root / "__init__.py", *sorted((root / "llm").glob("*.py"))]:
                z.write(file, file.relative_to(root.parent))
        sc.addPyFile(archive)
        _shipped.add(sc.applicationId)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id and text alone (other columns cannot clash); a null text is empty."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of its own only where the session names none (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, one_group: bool = False, few: bool = False) -> DataFrame:
    """Cuts the lineage: a table written to the shared folder of spark.checkpoint.dir and read again.

    Unlike a checkpoint, the table is compressed and does not carry the size estimates of the plan it came from into later
    joins. A folder of its own is used only where the session names none (tests). With one_group a file has one row group, so
    that a later scan never splits what one task wrote. With few, for tables of small rows such as links, an eighth of the partitions
    write it, so that repeated rounds do not fill the folder with tiny files.
    """
    if few:
        df = df.coalesce(max(1, parallelism(df) // 8))
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4()}"
    df.write.options(**({"parquet.block.size": (1 << 31) - 1} if one_group else {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in runs of about `limit` bytes of the given column (a longer row stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        yield batch.slice(start)


def held_out(modulus: int, remainder: int) -> Column:
    """Whether crc32 of the doc_id, written as text, leaves the remainder; a null doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def parallelism(df: DataFrame) -> int:
    """Partitions for a shuffle of this session."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """Left join to rows that are unique by `keys`; a key that holds many left rows is split by a hash of `by`."""
    left = left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")


def vocabulary_file(name: str) -> str:
    """Place of a public vocabulary file; imported late, since only queries on given vocabularies need it."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
