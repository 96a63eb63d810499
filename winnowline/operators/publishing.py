"""From decided rows to what is published: selection, order, pacing, validation, cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from winnowline.operators.ranges import ranked


def select_for_channel(cards: DataFrame, published: DataFrame, recent: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The next ``limit`` cards: not published by id or URL, not like one of this batch before it or a recent one of another source.

    ``recent`` and the batch are compared by ``likeness``, the key that near-duplicates share.
    """
    fresh = cards.join(published.select("id").distinct(), "id", "left_anti").join(published.where("url IS NOT NULL").select("url").distinct(), "url", "left_anti")
    elsewhere = recent.select("likeness", F.col("source").alias("__s")).distinct()
    fresh = fresh.join(elsewhere, (fresh["likeness"] == elsewhere["likeness"]) & (fresh["source"] != F.col("__s")), "left_anti")
    first = fresh.groupBy("likeness").agg(F.min(F.struct(*order, "id")).alias("f")).select(F.col("f.id").alias("id"))
    return fresh.join(first, "id", "left_semi").orderBy(*order, "id").limit(limit)


def interleave_position(df: DataFrame, bucket: Column, order: list[Column | str]) -> DataFrame:
    """Adds ``position`` (from 1): first rows of all buckets, then second rows and so on; buckets in the order of their first row.

    Rows are numbered inside a bucket by ranges of the order; the rounds before a turn are counted from the
    buckets' sizes, so no task sees all rows of a large bucket.
    """
    d = df.withColumn("__b", bucket)
    sizes = d.groupBy("__b").agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    sizes = sizes.withColumn("__rank", F.row_number().over(W.orderBy("first")))  # one row a bucket
    d = ranked(d, order, ["__b"], "__turn")
    # Rows of a turn are as many as buckets of that size or more: by size, from the largest.
    by_size = sizes.groupBy("n").agg(F.count("*").alias("c"))
    turns = by_size.select(F.explode(F.sequence(F.lit(1), "n")).alias("__turn"), "c").groupBy("__turn").agg(F.sum("c").alias("rows"))
    before = turns.select("__turn", F.coalesce(F.sum("rows").over(W.orderBy("__turn").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    d = d.join(sizes.select("__b", "__rank"), "__b").join(before, "__turn")
    place = F.row_number().over(W.partitionBy("__turn").orderBy("__rank"))
    return d.withColumn("position", F.col("__before") + place).drop("__b", "__turn", "__rank", "__before")


def pacing_plan(queue: DataFrame, order: list[Column | str], seed: int = 7, burst: tuple[int, int] = (2, 4), gap: tuple[float, float] = (60.0, 180.0), window: float = 3600.0, target: int = 40) -> DataFrame:
    """(id, burst, offset): the first ``target`` of a queue in bursts of seeded sizes and gaps, offsets held inside the window.

    Sizes and gaps come from hashes of (seed, burst), so a plan can be made again.
    """
    head = queue.orderBy(*order).limit(target).withColumn("place", F.row_number().over(W.orderBy(*order)))  # a window's worth
    part = lambda what: F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.lit(what), F.col("burst").cast("string"))), F.lit(1000)) / 1000
    bursts = queue.sparkSession.range(target).select((F.col("id") + 1).alias("burst"))
    bursts = bursts.select("burst", (F.lit(burst[0]) + F.floor(part("size") * (burst[1] - burst[0] + 1))).alias("size"), (F.lit(gap[0]) + part("gap") * (gap[1] - gap[0])).alias("gap"))
    run = W.orderBy("burst").rowsBetween(W.unboundedPreceding, 0)
    bursts = bursts.select("burst", (F.sum("size").over(run) - F.col("size")).alias("start"), F.sum("size").over(run).alias("end"), F.round(F.least(F.lit(window), F.sum("gap").over(run) - F.first("gap").over(run)), 3).alias("offset"))
    return head.join(F.broadcast(bursts), (F.col("place") > F.col("start")) & (F.col("place") <= F.col("end"))).select("id", "burst", "offset")  # target rows on either side


def validation(role: Column, substance: list[Column], summary: Column, salary: Column, url: Column, banned: tuple[str, ...]) -> Column:
    """reject reason (null if none) and warnings of a card."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    nothing = empty(substance[0])
    for s in substance[1:]:
        nothing = nothing & empty(s)
    reason = F.when(empty(role), "missing_role").when(nothing, "no_vacancy_substance").when(empty(summary), "missing_job_details")
    low = F.lower(summary)
    warnings = [F.when(F.contains(low, F.lit(b.lower())), f"banlist_in_summary:{b}") for b in banned]
    warnings += [F.when(F.trim(low).startswith(F.lower(F.trim(role))), "title_echo_in_summary"), F.when(~salary.rlike(r"\d"), "salary_no_digits"), F.when(~url.rlike("^https?://"), "unsafe_url_scheme")]
    return F.struct(reason.alias("reason"), F.when(reason.isNull(), F.array_compact(F.array(*warnings))).otherwise(F.array().cast("array<string>")).alias("warnings"))


def cut_at_word(text: Column, most: int) -> Column:
    """The text, or as many whole words as fit with a mark of omission."""
    head = F.substring(text, 1, most - 1)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.regexp_replace(head, r"\s+\S*$", ""), F.lit("…")))


def card(blocks: list[tuple[str, Column]], most: int, banned: tuple[str, ...] = ()) -> Column:
    """Blocks that have a value, a line each with its label, banned phrases taken out, cut to ``most`` characters."""
    lines = [F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.concat(F.lit(label), v)) for label, v in blocks]
    text = F.concat_ws("\n", *lines)
    for b in banned:
        text = F.regexp_replace(text, f"(?i){b}", "")
    return cut_at_word(text, most)


def compact(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Bounded columns for review: strings cut to so many characters, arrays to so many entries."""
    kinds = dict(df.dtypes)
    return df.select(*[F.slice(c, 1, n).alias(c) if kinds[c].startswith("array") else F.substring(c, 1, n).alias(c) if kinds[c] == "string" else F.col(c) for c, n in columns.items()])


def purge_runs(outcomes: DataFrame, run: str, most: int) -> DataFrame:
    """The rows of the newest ``most`` runs."""
    kept = outcomes.select(run).distinct().orderBy(F.desc(run)).limit(most)
    return outcomes.join(F.broadcast(kept), run, "left_semi")  # ``most`` rows
