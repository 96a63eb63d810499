"""Readers' votes on postings: tallies by posting and source, the most voted ones, and texts agreed on by enough readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_votes(votes: DataFrame) -> DataFrame:
    """The first vote of each user on each posting: a second press is no second opinion. Columns job_id, user_id, at and those of the posting.

    Votes of null users or on null postings are left out.
    """
    own = [c for c in votes.columns if c not in ("job_id", "user_id")]
    v = votes.where("job_id IS NOT NULL AND user_id IS NOT NULL")
    first = v.groupBy("job_id", "user_id").agg(F.min(F.struct("at", *[c for c in own if c != "at"])).alias("v"))
    return first.select("job_id", "user_id", "v.*")


def job_tallies(votes: DataFrame) -> DataFrame:
    """job_id, votes, and title, url, source_name and excerpt as in the posting's earliest vote."""
    first = F.min(F.struct("at", "user_id", "title", "url", "source_name", "excerpt")).alias("f")
    t = votes.groupBy("job_id").agg(F.count("*").alias("votes"), first)
    return t.select("job_id", "votes", "f.title", "f.url", "f.source_name", "f.excerpt")


def source_tallies(votes: DataFrame) -> DataFrame:
    """source_name ("unknown" if it is null or empty), votes and the number of postings voted on."""
    source = F.when(F.length("source_name") > 0, F.col("source_name")).otherwise("unknown").alias("source_name")
    return votes.groupBy(source).agg(F.count("*").alias("votes"), F.countDistinct("job_id").alias("jobs"))


def top_jobs(votes: DataFrame, n: int = 10) -> DataFrame:
    """The n postings with the most votes, equal ones by title, then id."""
    return job_tallies(votes).orderBy(F.desc("votes"), F.asc_nulls_last("title"), "job_id").limit(n)


def promotable(tallies: DataFrame, least_votes: int = 2, least_chars: int = 30) -> DataFrame:
    """Tallies that may become negative examples: enough votes and an excerpt of some length."""
    return tallies.where((F.col("votes") >= least_votes) & (F.length("excerpt") >= least_chars))
