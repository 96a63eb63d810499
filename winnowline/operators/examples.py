"""A table of example texts with roles: added once, found and cleared by role prefix, filtered before vectors are compared.

Rows have role, text, label and embedding. A role is a path with colons, as ``user:7@tenant:a:vacancy:positive``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnowline.operators import vectors

#: Categories of a profile's examples and their labels.
CATEGORIES = {"resume:positive": "positive", "resume:negative": "negative", "vacancy:positive": "positive", "vacancy:negative": "negative"}


def role_prefix(user: Column, tenant: Column) -> Column:
    return F.concat(F.lit("user:"), user.cast("string"), F.lit("@tenant:"), tenant.cast("string"), F.lit(":"))


def example_id(role: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", role, text), 256)


def profile_examples(profiles: DataFrame) -> DataFrame:
    """Examples of profiles (user_id, tenant_id, category, text, embedding) with role and label; blank texts and unknown categories are left out."""
    label = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    p = profiles.where("trim(text) <> ''").withColumn("label", F.try_element_at(label, F.col("category"))).where("label IS NOT NULL")
    return p.select(F.concat(role_prefix(F.col("user_id"), F.col("tenant_id")), F.col("category")).alias("role"), "text", "label", "embedding")


def add(store: DataFrame, new: DataFrame) -> DataFrame:
    """The store with the new examples that it does not hold under the same role; repeats among the new ones are added once.

    Of repeats the one with the smallest label counts, then any with that label (equal texts have equal vectors).
    """
    one = new.groupBy("role", "text").agg(F.min_by(F.struct("label", "embedding"), F.col("label")).alias("v")).select("role", "text", "v.*")
    fresh = one.join(store.select("role", "text"), ["role", "text"], "left_anti")
    return store.select("role", "text", "label", "embedding").unionByName(fresh.select("role", "text", "label", "embedding"))


def remove(store: DataFrame, gone: DataFrame) -> DataFrame:
    """The store without the (role, text) pairs of ``gone``."""
    return store.join(gone.select("role", "text").distinct(), ["role", "text"], "left_anti")


def clear(store: DataFrame, prefix: Column | str) -> DataFrame:
    """The store without the roles that begin with the prefix."""
    return store.where(~F.startswith("role", F.lit(prefix) if isinstance(prefix, str) else prefix))


def margins(rows: DataFrame, store: DataFrame, prefix: str, k: int = 5, **options) -> DataFrame:
    """vec_id, margin and max_margin of rows (vec_id, embedding) against the examples whose roles begin with the prefix.

    The prefix reaches the store's scan as a filter; null margins where a label has no example there.
    """
    own = store.where(F.startswith("role", F.lit(prefix)))
    return vectors.anchor_margin(rows, own.select(F.col("embedding").alias("anchor"), (F.col("label") == "positive").alias("positive")), k, **options)


def nearest(rows: DataFrame, store: DataFrame, prefix: str, k: int = 5, label: str | None = None) -> DataFrame:
    """query_id (a row), role, text, sim, rank: the k examples under the prefix (of one label, if given) nearest to each row."""
    s = store.withColumn("vec_id", example_id(F.col("role"), F.col("text")))
    where = F.startswith("role", F.lit(prefix))
    where = where if label is None else where & (F.col("label") == label)
    q = rows.select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("query"))
    n = vectors.nearest(s, q, k, where)
    return n.join(s.select("vec_id", "role", "text"), "vec_id").select("query_id", "role", "text", "sim", "rank")
