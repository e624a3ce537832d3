"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

T = TypeVar("T")

#: What counts as a word for operators that split on ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: ``bytes.translate`` table: A-Z become a-z, everything that is not a letter, digit or non-ASCII byte becomes a space.
WORD_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)

#: Folder of each application whose session names none.
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one local process (tests)
    may it be unset: then it is a new local folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        folder = _LOCAL[app]
    return folder.rstrip("/")


#: Rows of an Arrow batch at most: texts can be long, and a task holds a few batches at a time.
BATCH_ROWS = 1_000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows where they are larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, BATCH_ROWS)


#: Bytes of an Arrow batch at most where many steps follow each other in one session (Spark's default is 64 MB).
BATCH_BYTES = 8_000_000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES where they are larger."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(name).lower())
    if not now or not 0 < int(now[1]) * {"": 1, "k": 2**10, "m": 2**20, "g": 2**30}[now[2]] <= BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def released(batches: Iterator[T]) -> Iterator[T]:
    """``batches``; behind the last a worker gives the memory that it no longer uses back to the system, as workers stay."""
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # of glibc only
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discarded(df: DataFrame | None) -> None:
    """Delete the files of a table of :func:`stored`; what is still to be computed must not read it."""
    path = getattr(df, "_stored_at", None)
    if path:
        context = df.sparkSession.sparkContext
        target = context._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text leaves 2 modulo 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def raw(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def space_words(text: bytes) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09-0x0D); ``bytes.split`` knows exactly these six."""
    return text.split()


def plain_words(text: bytes) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.translate(WORD_TABLE).split()


#: Tables of keys with so many rows at most are broadcast (under 1 MB), larger ones are joined by a shuffle.
FEW_KEYS = 10_000


def least_rows(rows: DataFrame, key: str, most: int, salt: int) -> DataFrame:
    """A bounded sample of ``rows`` (doc_id, text and ``key``): at most ``most`` for each key, those with the least hash
    of id and text; rows equal in all three count once. What can't be among them is dropped before the exchange, by the
    share of the hash space that the sample needs, so a key that holds most rows makes no large task."""
    at = F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(salt)), 11) / F.lit(float(2**53))
    number = stored(rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_rows")), "keys")  # a row for each key
    number = F.broadcast(number) if number.count() <= FEW_KEYS else number
    few = rows.select("doc_id", "text", key, at.alias("_at")).join(number, F.col(key) == F.col("_key"))
    few = few.where(F.col("_at") * F.col("_rows") < F.lit(most + 8 * most**0.5))
    few = few.groupBy("doc_id", key, "_at").agg(F.first("text").alias("text"))
    few = few.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy("_at", "doc_id")))
    return few.where(F.col("_rank") <= most).select("doc_id", "text", key, "_rank")
