"""Live folds: keyed state for what a rollout has seen, and event-time windows (an extension beyond the batch engine)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_disclosure(turns: DataFrame) -> DataFrame:
    """A stream of (case_id, turn, ids, valid) as (case_id, turn, fresh): what each turn adds to what the case has seen."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0]) if state.exists else set()
        for batch in batches:
            rows = []
            for turn, ids, valid in batch.sort_values("turn")[["turn", "ids", "valid"]].itertuples(index=False):
                fresh = [i for i in dict.fromkeys(ids) if i not in seen] if valid else []
                seen.update(fresh)
                rows.append((key[0], turn, fresh))
            yield pd.DataFrame(rows, columns=["case_id", "turn", "fresh"])
        state.update((sorted(seen),))

    return turns.groupBy("case_id").applyInPandasWithState(fold, "case_id string, turn int, fresh array<string>", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def windowed_events(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Counts and sums by event-time window and type; works on streams and on tables."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")
