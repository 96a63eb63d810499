"""Counters that come with a write: what entered each node of a plan and how it left it, without another scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: How a row leaves a node; a null outcome counts as passed.
OUTCOMES = ("passed", "dropped", "skipped", "errors")


class NodeCounters:
    """Watches nodes of one plan by ``Observation``; ``rows`` has the figures once an action has run the plan.

    Figures are those of the first action on the watched plan; a plan that is run again counts no more.
    """

    def __init__(self):
        self.watched: dict[str, Observation] = {}

    def watch(self, df: DataFrame, node: str, outcome: Column, cost: Column | None = None) -> DataFrame:
        """``df``, with every row counted by its outcome (one of OUTCOMES); ``cost`` is averaged."""
        if node in self.watched:
            raise ValueError(f"{node} is watched already")
        self.watched[node] = Observation(f"{node}-{id(self)}")
        how = F.coalesce(outcome, F.lit("passed"))
        mean = F.avg(cost) if cost is not None else F.lit(None).cast("double")
        return df.observe(self.watched[node], F.count(F.lit(1)).alias("entered"), *[F.count_if(how == o).alias(o) for o in OUTCOMES], F.max(F.lit(None).cast("double")).alias("mean_cost") if cost is None else mean.alias("mean_cost"))

    def rows(self, spark: SparkSession) -> DataFrame:
        """node, entered, passed, dropped, skipped, errors, conversion (passed of entered, 0 for none), mean_cost; as many rows as nodes."""
        out = []
        for node, seen in self.watched.items():
            x = seen.get
            out.append((node, x["entered"], *[x[o] for o in OUTCOMES], round(x["passed"] / x["entered"], 4) if x["entered"] else 0.0, x["mean_cost"]))
        return spark.createDataFrame(out, "node string, entered long, passed long, dropped long, skipped long, errors long, conversion double, mean_cost double")
