"""Digests in parts: one text with several bulleted entries becomes several candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line that begins an entry: a number with a dot or bracket, or a dash, star or bullet, and a blank.
ENTRY_LINE = r"\n[ \t]*([0-9]+[.)][ \t]|[-*•][ \t])"
MARK = "\x01"


def parts(text: Column) -> Column:
    """The text cut before each line that begins an entry; trimmed, blank parts left out."""
    cut = F.split(F.regexp_replace(F.translate(text, MARK, ""), ENTRY_LINE, MARK + "$1"), MARK)
    return F.filter(F.transform(cut, lambda x: F.regexp_replace(x, r"^[ \t\r\n]+|[ \t\r\n]+$", "")), lambda x: x != "")


def segments(text: Column, hint: str, least: int = 2) -> Column:
    """The parts, if ``least`` of them match the pattern ``hint``; else the whole text as it is. Null has none."""
    own = parts(text)
    return F.when(F.size(F.filter(own, lambda x: x.rlike(hint))) >= least, own).when(text.isNotNull(), F.array(text))


def explode_segments(df: DataFrame, key: str, text: str, hint: str, declared: str | None = None) -> DataFrame:
    """key, ordinal, segment, evidence, segment_id: a row for each part, with an id that stays while its text and place do.

    Parts that the source itself declares (an array column ``declared``, blank ones left out) come before any cut.
    """
    given = F.filter(F.transform(F.coalesce(F.col(declared), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "") if declared else F.array().cast("array<string>")
    found = segments(F.col(text), hint)
    evidence = F.when(F.size("given") > 0, "source_declared_segment").when(F.size("found") > 1, "digest_boundary").otherwise("whole_observation")
    d = df.select(key, given.alias("given"), found.alias("found")).withColumn("evidence", evidence)
    d = d.select(key, "evidence", F.posexplode(F.when(F.size("given") > 0, F.col("given")).otherwise(F.col("found"))).alias("ordinal", "segment"))
    return d.select(key, "ordinal", "segment", "evidence", F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("ordinal").cast("string"), "segment"), 256).alias("segment_id"))
