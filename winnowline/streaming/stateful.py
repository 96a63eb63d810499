"""Keyed state across runs: claims that commit or release, marks that expire, parents that end with their last child.

The streams keep their state in the checkpoint (``transformWithStateInPandas``), so a restart goes on
where the last run ended. The batch form of the claims folds the same rules over rows in order.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Held(NamedTuple):
    """A key's open claim and since when, and when it was last committed (milliseconds)."""

    claim: str | None = None
    since: int | None = None
    marked: int | None = None

    def ends(self, ttl: int, lease: int) -> list[int]:
        """When the mark and the lease run out, if there are any."""
        return [t + span for t, span in ((self.marked, ttl), (self.since, lease)) if t is not None]


def settle(held: Held, action: str, claim: str, at: int, ttl: int, lease: int) -> tuple[str, Held]:
    """(outcome, state afterwards) of one row.

    A claim is a ``duplicate`` within ``ttl`` of a commit, ``busy`` while another claim's lease runs, else
    ``granted`` (again, to its holder). A commit or release counts within the lease of its own claim only and is
    ``stale`` otherwise; other actions are ``ignored``.
    """
    open_ = held.claim is not None and at < held.since + lease
    if action == "claim":
        if held.marked is not None and at < held.marked + ttl:
            return "duplicate", held
        if open_ and held.claim != claim:
            return "busy", held
        return "granted", held._replace(claim=claim, since=at)
    if action not in ("commit", "release"):
        return "ignored", held
    if not open_ or held.claim != claim:
        return "stale", held
    return ("committed", Held(marked=at)) if action == "commit" else ("released", held._replace(claim=None, since=None))


def _milliseconds(times: pd.Series) -> list[int]:
    return (times.astype("datetime64[ms]").astype("int64")).tolist()


class _Claims(StatefulProcessor):
    def __init__(self, ttl: int, lease: int):
        self.ttl, self.lease = ttl, lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", "claim string, since long, marked long")

    def _held(self) -> Held:
        return Held(*self.state.get()) if self.state.exists() else Held()

    def handleInputRows(self, key, rows, timerValues):
        batch = pd.concat(list(rows)).sort_values(["at", "row"], kind="stable")
        held, outcomes = self._held(), []
        times = _milliseconds(batch["at"])
        for action, claim, at in zip(batch["action"], batch["claim"], times):
            outcome, held = settle(held, action, claim, at, self.ttl, self.lease)
            outcomes.append(outcome)
        if held == Held():
            self.state.clear()
        else:
            self.state.update(tuple(held))
            # Once neither mark nor lease can matter any more, the state goes.
            self.handle.registerTimer(max(held.ends(self.ttl, self.lease)))
        yield pd.DataFrame({"key": [key[0]] * len(batch), "row": batch["row"], "outcome": outcomes})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if all(end <= expiredTimerInfo.getExpiryTimeInMs() for end in self._held().ends(self.ttl, self.lease)):
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def _ms(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


def claims_stream(rows: DataFrame, ttl: str, lease: str, lateness: str = "1 day") -> DataFrame:
    """key, row, outcome for a stream of (key, row, action, claim, at), by ``settle`` in the order of at and row.

    State outlives a run by the checkpoint and goes once the watermark has passed mark and lease; rows older
    than the watermark are dropped. Needs the RocksDB state store (``PROVIDER``).
    """
    kinds = dict(rows.dtypes)
    own = rows.select("key", "row", "action", "claim", "at").withWatermark("at", lateness)
    return own.groupBy("key").transformWithStateInPandas(_Claims(_ms(ttl), _ms(lease)), f"key {kinds['key']}, row {kinds['row']}, outcome string", "Append", "EventTime")


def claims_batch(rows: DataFrame, ttl: str, lease: str) -> DataFrame:
    """The same for a table: keys are dealt to tasks and run through in order, so of a hot key only a batch is held at a time."""
    kinds, ttl_ms, lease_ms = dict(rows.dtypes), _ms(ttl), _ms(lease)

    def run(batches):
        last, held = None, Held()
        for batch in batches:
            outcomes = []
            for key, action, claim, at in zip(batch["key"].tolist(), batch["action"], batch["claim"], _milliseconds(batch["at"])):
                last, held = (last, held) if key == last else (key, Held())
                outcome, held = settle(held, action, claim, at, ttl_ms, lease_ms)
                outcomes.append(outcome)
            yield batch[["key", "row"]].assign(outcome=outcomes)

    ordered = rows.where("key IS NOT NULL").select("key", "row", "action", "claim", "at").repartition("key").sortWithinPartitions("key", "at", "row")
    return ordered.mapInPandas(run, f"key {kinds['key']}, row {kinds['row']}, outcome string")


class _Parents(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("children", "done array<string>, closed boolean")

    def handleInputRows(self, key, rows, timerValues):
        held = self.state.get()
        done, closed = held if held is not None else ([], False)
        if closed:
            return
        seen, expected = set(done), 0
        for row in rows:
            if row.final:
                seen.add(row.child)
            expected = max(expected, row.expected or 0)
        closed = len(seen) >= expected > 0
        self.state.update(([], True) if closed else (sorted(seen), False))
        if closed:
            yield Row(parent=key[0], children=len(seen))

    def close(self) -> None:
        pass


def finished_parents(rows: DataFrame) -> DataFrame:
    """parent, children, once, when as many distinct children of a parent as it expects have ended; rows are (parent, child, final, expected).

    A child counts from its first final row on, in whatever run; rows of a parent that has ended change nothing.
    """
    kind = dict(rows.dtypes)["parent"]
    own = rows.select("parent", F.col("child").cast("string").alias("child"), F.coalesce("final", F.lit(False)).alias("final"), F.col("expected").cast("long").alias("expected"))
    return own.groupBy("parent").transformWithState(_Parents(), f"parent {kind}, children long", "Append", "None")


def with_state_store(spark):
    """Streams with keyed state need this provider; a session that has one set keeps it."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in (spark.conf.get(name, "") or ""):
        spark.conf.set(name, PROVIDER)
    return spark
