"""Shared pieces: scratch tables in the cluster's shared folder, word columns, batches of documents."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode, where they are one process, is one set if none is configured."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, codec: str | None = None, group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends there, so a lost executor costs a reread and not a recomputation, and the files
    give Spark an exact size: a small table is broadcast by Spark's own size check, a large one isn't.
    ``group_bytes`` is for rows of megabytes: a task holds the rows of a row group at once, as writer and
    as reader, and without it looks at their size only after a hundred of them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/winnowline-{uuid.uuid4().hex}"
    options = {"compression": codec} if codec else {}
    if group_bytes:
        options |= {"parquet.block.size": str(group_bytes), "parquet.page.size.row.check.min": "1"}
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def set_aside(docs: DataFrame, *named: str):
    """(docs with every column but those named under a name that no operator uses; a function that gives the names back).

    So columns that an operator adds for itself can't clash with the caller's, whatever these are called.
    """
    own = docs.columns
    return docs.toDF(*[c if c in named else f"winnowline_aside_{i}" for i, c in enumerate(own)]), lambda out: out.toDF(*own)


def word_array(text: Column) -> Column:
    """The words of a text in order; an empty array for null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def batches_for(docs: DataFrame, text: str, batch_bytes: int, least_bytes: int = 1 << 20) -> int:
    """How many hash batches keep the text of one batch near ``batch_bytes`` on average; a small table is dealt to all cores in batches of ``least_bytes`` or more."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(1, math.ceil(total / batch_bytes), min(2 * cores, total // least_bytes))


def held_out(key: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id, written as text, leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string")) % modulus == remainder, F.lit(False))
