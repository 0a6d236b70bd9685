"""Streams that remember: the last runs of each key, with state that survives a restart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_runs(events: DataFrame, key: str, order: str, value: str, most: int) -> DataFrame:
    """(key, runs, last): after each batch, for every key with new rows, how many rows it has had, and the values of its last
    ``most`` by ``order`` (ties by value), oldest first, joined by commas. Late rows take the place that their order gives
    them: the state holds the last rows by order, not by arrival, so a stream ends as a batch would. Null keys are a key."""
    rows = events.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("order"), F.col(value).cast("string").alias("value")).where(F.col("order").isNotNull())

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, kept = (state.get[0], [tuple(x) for x in zip(state.get[1], state.get[2], strict=True)]) if state.exists else (0, [])
        for batch in batches:
            n += len(batch)
            kept = sorted(kept + list(zip(batch["order"].tolist(), batch["value"].fillna("").tolist(), strict=True)))[-most:]
        state.update((n, [o for o, _ in kept], [v for _, v in kept]))
        yield pd.DataFrame({"key": [k[0]], "runs": [n], "last": [",".join(v for _, v in kept)]})

    return rows.groupBy("key").applyInPandasWithState(run, "key string, runs long, last string", "n long, orders array<long>, values array<string>", "update", GroupStateTimeout.NoTimeout)
