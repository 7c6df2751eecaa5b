"""Per-session de-duplication and event counts, as batch windows and as streams with watermarks."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def first_in_session(df: DataFrame, session: str | list[str], key: str, order: list[str], always: Column | None = None) -> DataFrame:
    """Rows whose key appears for the first time in their session, and all that are to be shown ``always``; those count as seen too.

    A window over (session, key): a hot session is spread by its keys.
    """
    w = Window.partitionBy(*([session] if isinstance(session, str) else session), key).orderBy(*order)
    shown = F.col("_n") == 1 if always is None else (F.col("_n") == 1) | F.coalesce(always, F.lit(False))
    return df.withColumn("_n", F.row_number().over(w)).where(shown).drop("_n")


def with_epochs(df: DataFrame, session: str, at: str, order: list[str], reset: Column, slot: str = "hour") -> DataFrame:
    """Rows with ``epoch``: the resets of their session up to and including the row.

    Resets are counted by slot of time first; a second sum runs over a session's slots, not its rows, and a third over
    the rows of one slot. So of a hot session only the rows of one slot meet in one task; a busier log takes a finer
    ``slot``. A null session is one of its own.
    """
    rows = df.withColumn("_slot", F.date_trunc(slot, at)).withColumn("_reset", F.coalesce(reset, F.lit(False)).cast("long"))
    slots = rows.groupBy(F.col(session).alias("_s"), F.col("_slot").alias("_t")).agg(F.sum("_reset").alias("_here"))
    before = Window.partitionBy("_s").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.withColumn("_before", F.coalesce(F.sum("_here").over(before), F.lit(0))).drop("_here")
    both = rows.join(slots, F.col(session).eqNullSafe(F.col("_s")) & F.col("_slot").eqNullSafe(F.col("_t")))
    inside = Window.partitionBy(session, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("epoch", F.col("_before") + F.sum("_reset").over(inside)).drop("_slot", "_reset", "_s", "_t", "_before")


def dedup_stream(stream: DataFrame, session: str, key: str, event_time: str, delay: str = "3 days") -> DataFrame:
    """A stream with each (session, key) once within the watermark; state leaves with it."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([session, key])


def first_since_reset_stream(stream: DataFrame, session: str, key: str, order: list[str], reset: Column, parts: int = 16, idle_ms: int | None = None) -> DataFrame:
    """The stream form of ``with_epochs`` and ``first_in_session``: ``session, key`` and ``order`` of what is shown first since a reset.

    State is a set of keys for each session and part of the keys, so a hot session is spread over ``parts`` tasks; a
    reset goes to all of them. Rows of one micro-batch are taken in order; a row that comes later than that counts when
    it comes. State leaves with a reset and, in a stream that runs on, after ``idle_ms`` without rows
    (a run that ends with the data at hand must have none, as Spark would go on waiting for it). Rows that have no key and reset nothing
    are left out. A null session is one of its own.
    """
    rows = stream.select(F.col(session).alias("s"), F.col(key).cast("string").alias("k"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.coalesce(reset, F.lit(False)).alias("r"))
    all_parts, own = F.sequence(F.lit(0), F.lit(parts - 1)), F.array(F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int"))
    rows = rows.where("r OR k IS NOT NULL").withColumn("p", F.explode(F.when(F.col("r"), all_parts).otherwise(own)))
    places = [f"o{i}" for i in range(len(order))]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in ("s", "k", *places))

    def step(group, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        seen, shown = set(state.get[0]) if state.exists else set(), []
        batch = pd.concat(list(frames)).sort_values([*places, "r"], ascending=[True] * len(places) + [False], kind="stable")
        for at, (name, resets) in enumerate(zip(batch["k"], batch["r"])):
            if resets:
                seen.clear()
            elif name not in seen:
                seen.add(name)
                shown.append(at)
        state.update((sorted(seen),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield batch.iloc[shown][["s", "k", *places]]

    found = rows.groupBy("s", "p").applyInPandasWithState(step, kinds, "seen array<string>", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
    return found.select(F.col("s").alias(session), F.col("k").alias(key), *[F.col(p).alias(c) for p, c in zip(places, order)])


def counts_by_window(df: DataFrame, event_time: str, keys: list[str], width: str = "1 hour", delay: str = "3 days") -> DataFrame:
    """Events per tumbling window and key; for a batch the watermark has no effect."""
    rows = df.withWatermark(event_time, delay) if df.isStreaming else df
    return rows.groupBy(F.window(event_time, width).alias("w"), *keys).agg(F.count(F.lit(1)).alias("events")).select(F.col("w.start").alias("window_start"), *keys, "events")
