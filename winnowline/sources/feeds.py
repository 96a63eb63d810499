"""Landed feed and board files as a source with a cursor: what is new goes on, what is broken is set apart, each once.

Files lie in one folder for each source (``source=<name>/...``). A stream reads them with Spark's own reader,
so any store will do, and takes them apart in columns: XML feeds by ``from_xml``, JSON boards by paths. The
checkpoint is the cursor; it moves on only when a batch has been written in full. A batch that is run again
overwrites what its first attempt left, so every entry is written once.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from winnowline.functions import paths
from winnowline.streaming.stateful import with_state_store

ENTRY = "guid string, link string, title string, body string, published string"
FEED = "channel struct<item: array<struct<guid string, link string, title string, description string, pubDate string>>>"


def landed(spark: SparkSession, path: str, files: int = 64) -> DataFrame:
    """(value, source): a stream of whole files, ``files`` of them in a batch at most."""
    return spark.readStream.schema("value string, source string").option("wholetext", "true").option("maxFilesPerTrigger", files).text(path)


def feed_items(text: Column) -> Column:
    """The items of an RSS document as an array of entries; null if it is no feed."""
    items = F.from_xml(text, FEED, {"mode": "PERMISSIVE"})["channel"]["item"]
    return F.transform(items, lambda x: F.struct(x["guid"].alias("guid"), x["link"].alias("link"), x["title"].alias("title"), x["description"].alias("body"), x["pubDate"].alias("published")))


def board_items(text: Column, items: str, fields: dict[str, str]) -> Column:
    """The entries of a JSON page by paths (fields of ENTRY that are absent are null); null if it is no JSON."""
    page = F.try_parse_json(text)
    own = paths.records(page, items, fields)
    names = [c.split()[0] for c in ENTRY.split(", ")]
    full = F.transform(own, lambda x: F.struct(*[(x[c] if c in fields else F.lit(None).cast("string")).alias(c) for c in names]))
    return F.when(page.isNotNull(), full)


def moment(text: Column) -> Column:
    """An RFC 822 or ISO time."""
    bare = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, ", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(bare))


def entries(files: DataFrame, items: Column, cutoff: str | None = None) -> DataFrame:
    """source, id, the fields of an entry, and reason: null for good rows, else why a row is set apart.

    A file that can't be read is one row (``invalid_file``); an entry needs a guid or a link (``no_identity``)
    and, where there is a ``cutoff``, a date (``undated``) that is not before it (``old``).
    """
    d = files.select("source", "value", items.alias("items"))
    d = d.select("source", F.when(F.isnull("items"), F.col("value")).alias("file"), F.explode_outer("items").alias("x"))
    d = d.where("x IS NOT NULL OR file IS NOT NULL")
    blank = lambda c: F.nullif(F.trim(F.col(f"x.{c}")), F.lit(""))
    d = d.select("source", "file", F.coalesce(blank("guid"), blank("link")).alias("id"), *[blank(c).alias(c) for c in ("guid", "link", "title", "body")], moment(F.col("x.published")).alias("published"))
    reason = F.when(F.col("file").isNotNull(), "invalid_file").when(F.isnull("id"), "no_identity")
    if cutoff:
        reason = reason.when(F.isnull("published"), "undated").when(F.col("published") < F.lit(cutoff).cast("timestamp"), "old")
    return d.withColumn("reason", reason)


class _Seen(StatefulProcessor):
    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ids", "ids array<string>")

    def handleInputRows(self, key, rows, timerValues):
        known = dict.fromkeys(self.state.get()[0] if self.state.exists() else ())
        for batch in rows:
            good = batch["reason"].isna()
            fresh = []
            for identity, ok in zip(batch["id"], good):
                fresh.append(not ok or identity not in known)
                if ok:
                    known.pop(identity, None)  # seen last
                    known[identity] = None
            yield batch[pd.Series(fresh, index=batch.index)]
        self.state.update((list(known)[-self.most :],))

    def close(self) -> None:
        pass


def unseen(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Entries whose id their source has not had, in this run or an earlier one; rows set apart stay.

    Each (source, id) is a key of Spark's state, so a large source is shared by all tasks. With ``most`` a source
    knows only its latest so many ids, which one task holds together.
    """
    if most is None:
        fresh = rows.where("reason IS NULL").dropDuplicates(["source", "id"])
        return fresh.unionByName(rows.where("reason IS NOT NULL"))
    shape = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return rows.groupBy("source").transformWithStateInPandas(_Seen(most), shape, "Append", "None")


def poll(rows: DataFrame, out: str, checkpoint: str, after_write=None) -> tuple[DataFrame, DataFrame]:
    """Runs the stream over what has landed since the last run: (all entries so far, all rows set apart so far).

    ``after_write`` is called with the number of each batch before the cursor moves on.
    """
    spark = with_state_store(rows.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        kept.where("reason IS NULL").drop("reason", "file").write.mode("overwrite").parquet(f"{out}/entries/batch={number}")
        kept.where("reason IS NOT NULL").select("source", "id", "file", "reason").write.mode("overwrite").parquet(f"{out}/apart/batch={number}")
        kept.unpersist()
        if after_write:
            after_write(number)

    rows.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/entries"), spark.read.parquet(f"{out}/apart")
