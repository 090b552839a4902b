"""What the text operators share: the shared folder, tables written between steps, and words.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split()`` returns; ``bytes.lower()``
lowers A-Z only. Texts reach Python as UTF-8 bytes, so no task decodes a text it only needs to cut at white space.
"""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of a word, as a Java and RE2 character class.
SPACE_CLASS = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset (tests), a local folder is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """df as a table written to the shared folder: the lineage ends there, and a lost executor costs no earlier step. by: a
    column whose values have folders of their own."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tidied(run):
    """run (Arrow data in, Arrow data out), after which a Python worker, which goes on to other tasks, gives freed memory back."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()

    return wrapped


def slices(data, rows: int = 512):
    """An Arrow batch or array in slices, so that a task holds few texts as Python objects at once; an empty one as it is."""
    for i in range(0, max(len(data), 1), rows):
        yield data.slice(i, rows)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from the columns (in either case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def byte_rows(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words_of(text: Column) -> Column:
    """The words of a text as an array, in JVM expressions; null and empty texts have none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES)), " "), lambda w: w != "")


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered; the memory is bounded by starting anew."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value
