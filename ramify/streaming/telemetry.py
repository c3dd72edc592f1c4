"""Lag and rate of an event table or stream, per key."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ramify.operators.ranking import grouped_running
from ramify.store import materialize

_BLOCK = 256


def millis(df: DataFrame, ts: str) -> Column:
    """Milliseconds since 1970; a time without zone is taken as it stands."""
    t = F.col(ts)
    if dict(df.dtypes)[ts] != "timestamp_ntz":
        return F.unix_micros(t) / 1000.0
    seconds = F.hour(t) * 3600 + F.minute(t) * 60 + F.extract(F.lit("SECOND"), t).cast("double")
    return F.unix_date(t.cast("date")) * 86400000.0 + seconds * 1000.0


def ewma_lag(
    events: DataFrame,
    key: str,
    ts: str,
    tie: str,
    interval_ms: float = 500.0,
    alpha: float = 0.2,
    alert_ms: float = 0.5,
) -> DataFrame:
    """Smoothed lag after every event of a key: input columns, ``lag_ms``, ``alert``.

    drift = gap to the previous event - interval;
    lag = max(0, alpha * drift + (1 - alpha) * lag), 0 at the first event.

    One step maps the lag x to max(c, a + b * x), and such maps compose to maps
    of the same form. So the events of a key are cut into blocks of bounded
    size, each block is composed to one map, the block maps are chained the
    same way, and every block is then folded from the lag it starts with.
    """
    timed = events.withColumn("_ms", millis(events, ts))
    numbered = grouped_running(timed, [key], [F.col(ts), F.col(tie)], "_n")
    block = F.floor((F.col("_n") - 1) / _BLOCK)
    last = numbered.select(
        key, (F.col("_n") + 1).alias("_n"), F.col("_ms").alias("_before")
    ).filter(F.col("_n") % _BLOCK == 1)
    in_block = Window.partitionBy(key, "_block").orderBy("_n")
    # The previous event of a block's first event is in the block before.
    steps = (
        numbered.withColumn("_block", block)
        .join(last, [key, "_n"], "left")
        .withColumn("_prev", F.coalesce(F.lag("_ms").over(in_block), F.col("_before")))
        .withColumn(
            "_a", F.coalesce(alpha * (F.col("_ms") - F.col("_prev") - interval_ms), F.lit(0.0))
        )
        .withColumn("_b", F.when(F.col("_prev").isNull(), 0.0).otherwise(1.0 - alpha))
    )
    steps = materialize(steps.select(*events.columns, "_n", "_block", "_a", "_b"), "ewma-steps")
    starts = _block_starts(steps.withColumn("_c", F.lit(0.0)).select(key, "_n", "_block", "_a", "_b", "_c"), key)
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_a", "_b")))
    # Fold: the list of lags so far, starting from the lag at the block's start.
    folded = (
        steps.groupBy(key, "_block")
        .agg(ordered.alias("_steps"))
        .join(starts, [key, "_block"])
        .select(
            key,
            "_block",
            F.expr(
                """aggregate(_steps,
                     named_struct('x', _start, 'out', cast(array() as array<struct<n: bigint, lag: double>>)),
                     (s, e) -> named_struct(
                       'x', greatest(0.0D, e._a + e._b * s.x),
                       'out', concat(s.out, array(named_struct('n', e._n, 'lag', greatest(0.0D, e._a + e._b * s.x))))),
                     s -> s.out)"""
            ).alias("_out"),
        )
        .select(key, F.explode("_out").alias("_o"))
        .select(key, F.col("_o.n").alias("_n"), F.col("_o.lag").alias("lag_ms"))
    )
    return (
        steps.join(folded, [key, "_n"])
        .withColumn("alert", F.col("lag_ms") > alert_ms)
        .select(*events.columns, "lag_ms", "alert")
    )


def _block_starts(steps: DataFrame, key: str) -> DataFrame:
    """Lag with which each block of each key starts: (key, _block, _start).

    ``steps(key, _n, _block, _a, _b, _c)`` are maps in order, ``_block`` cuts them.
    """
    ordered = F.array_sort(F.collect_list(F.struct("_n", "_a", "_b", "_c")))
    maps = materialize(
        steps.groupBy(key, "_block").agg(ordered.alias("_steps")).select(
            key,
            "_block",
            F.expr(
                """aggregate(_steps,
                     named_struct('a', 0.0D, 'b', 1.0D, 'c', cast('-Infinity' as double)),
                     (s, e) -> named_struct(
                       'a', e._a + e._b * s.a,
                       'b', e._b * s.b,
                       'c', greatest(e._c, e._a + if(e._b = 0, 0.0D, e._b * s.c))))"""
            ).alias("m"),
        ),
        "ewma-blocks",
    )
    blocks = maps.select(
        key, (F.col("_block") + 1).alias("_n"), F.floor(F.col("_block") / _BLOCK).alias("_block"),
        F.col("m.a").alias("_a"), F.col("m.b").alias("_b"), F.col("m.c").alias("_c"),
    )
    if blocks.filter("_block > 0").isEmpty():
        outer = blocks.select(key, "_block", F.lit(0.0).alias("_start")).distinct()
    else:
        outer = _block_starts(blocks, key)
    inside = F.array_sort(F.collect_list(F.struct("_n", "_a", "_b", "_c")))
    return (
        blocks.groupBy(key, "_block")
        .agg(inside.alias("_steps"))
        .join(outer, [key, "_block"])
        .select(
            key,
            F.explode(
                F.expr(
                    """aggregate(_steps,
                         named_struct('x', _start, 'out', cast(array() as array<struct<n: bigint, start: double>>)),
                         (s, e) -> named_struct(
                           'x', greatest(e._c, e._a + e._b * s.x),
                           'out', concat(s.out, array(named_struct('n', e._n, 'start', s.x)))),
                         s -> s.out)"""
                )
            ).alias("_o"),
        )
        .select(key, (F.col("_o.n") - 1).alias("_block"), F.col("_o.start").alias("_start"))
    )


def event_rate(events: DataFrame, key: str, ts: str, window_ms: int = 125) -> DataFrame:
    """Events per second in fixed windows: (key, window_start, events, rate, ms_per_event).

    Works on a table and on a stream (set a watermark on ``ts`` first). The
    rate and the milliseconds per event are rounded with halves upward.
    """
    rate = F.floor(F.col("events") / (window_ms / 1000.0) + 0.5)
    return (
        events.groupBy(key, F.window(ts, f"{window_ms} milliseconds").alias("_w"))
        .agg(F.count(F.lit(1)).alias("events"))
        .withColumn("rate", rate)
        .withColumn("ms_per_event", F.when(F.col("rate") > 0, F.floor(1000 / F.col("rate") + 0.5)).otherwise(F.lit(0)))
        .select(key, F.col("_w.start").alias("window_start"), "events", "rate", "ms_per_event")
    )


def event_rate_closing(events: DataFrame, key: str, ts: str, tie: str, interval_ms: float = 125.0) -> DataFrame:
    """Events per second in windows that an event closes: (key, started, closed, events, rate, ms_per_event).

    The first event of a key starts the clock. A window closes at the first event at
    least ``interval_ms`` after the last close, and counts the events after that close up
    to its own; what follows the last close is no window. Rounding as in ``event_rate``.

    Every event points at the event that would close a window begun there, found by a
    count over events and ends in one order. The closes are the events that the pointers
    reach from the first; each round doubles the length of the pointers, so the rounds are
    log2 of the number of windows, whatever a key's share of the events.
    """
    times = grouped_running(events.select(key, ts, tie).withColumn("_ms", millis(events, ts)), [key], [F.col(ts), F.col(tie)], "_n")
    times = materialize(times.select(key, F.col(ts).alias("_ts"), "_ms", "_n"), "rate-times")
    ends = times.select(key, (F.col("_ms") + interval_ms).alias("_ms"), "_n", F.lit(0).alias("_event"))
    both = ends.unionByName(times.select(key, "_ms", "_n", F.lit(1).alias("_event")))
    passed = grouped_running(both, [key], ["_ms", "_event", "_n"], "_nr", {"_passed": F.col("_event")}).filter("_event = 0")
    jump = passed.select(key, "_n", (F.col("_passed") + 1).alias("_to"))
    some = times.select(key, F.col("_n").alias("_to"))
    jump = materialize(jump.join(some, [key, "_to"], "left_semi").select(key, "_n", "_to"), "rate-jumps")
    nearest = jump
    closes = materialize(times.filter("_n = 1").select(key, "_n"), "rate-closes")
    while not jump.isEmpty():
        met = closes.join(jump, [key, "_n"]).select(key, F.col("_to").alias("_n"))
        closes = materialize(closes.unionByName(met), "rate-closes")
        further = jump.select(key, F.col("_n").alias("_to"), F.col("_to").alias("_further"))
        jump = materialize(jump.join(further, [key, "_to"]).select(key, "_n", F.col("_further").alias("_to")), "rate-jumps")
    begun = times.select(key, "_n", F.col("_ts").alias("started"), F.col("_ms").alias("_from"))
    ended = times.select(key, F.col("_n").alias("_to"), F.col("_ts").alias("closed"), F.col("_ms").alias("_till"))
    windows = closes.join(nearest, [key, "_n"]).join(begun, [key, "_n"]).join(ended, [key, "_to"])
    count = F.col("_to") - F.col("_n")
    return (
        windows.withColumn("events", count)
        .withColumn("rate", F.floor(F.col("events") / ((F.col("_till") - F.col("_from")) / 1000.0) + 0.5))
        .withColumn("ms_per_event", F.when(F.col("rate") > 0, F.floor(1000 / F.col("rate") + 0.5)).otherwise(F.lit(0)))
        .select(key, "started", "closed", "events", "rate", "ms_per_event")
    )


def ewma_lag_stream(
    events: DataFrame,
    key: str,
    ts: str,
    tie: str,
    delay: str = "10 minutes",
    interval_ms: float = 500.0,
    alpha: float = 0.2,
    alert_ms: float = 0.5,
    forget_ms: float | None = None,
) -> DataFrame:
    """Streaming form of ``ewma_lag``: the same rows, for input at most ``delay`` late.

    The events of a key wait in its state until the watermark has passed them, so that
    late ones find their place, and are folded in the order of time and ``tie``. A key is
    kept for good, or until ``forget_ms`` after its last event.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    types = dict(events.dtypes)
    out = f"{key} {types[key]}, {tie} {types[tie]}, ts_ms double, lag_ms double, alert boolean"

    def step(k, batches, state: GroupState):
        lag, last, times, ties = state.get if state.exists else (0.0, None, [], [])
        waiting = list(zip(times, ties))
        if not state.hasTimedOut:
            for rows in batches:
                waiting += zip(rows["_ms"].tolist(), rows[tie].tolist())
        waiting.sort()
        passed = state.getCurrentWatermarkMs()
        found = []
        ready = bisect_left(waiting, (passed,))
        for ms, event_id in waiting[:ready]:
            if last is not None:
                lag = max(0.0, alpha * (ms - last - interval_ms) + (1 - alpha) * lag)
            last = ms
            found.append((k[0], event_id, ms, lag, lag > alert_ms))
        del waiting[:ready]
        if not waiting and last is not None and forget_ms is not None and last + forget_ms < passed:
            state.remove()
        else:
            state.update((lag, last, [m for m, _ in waiting], [i for _, i in waiting]))
            wake = waiting[0][0] if waiting else last + forget_ms if forget_ms is not None else None
            if wake is not None:
                state.setTimeoutTimestamp(int(max(wake, passed)) + 1)
        if found:
            yield pd.DataFrame(found, columns=[key, tie, "ts_ms", "lag_ms", "alert"])

    return (
        events.withWatermark(ts, delay)
        .select(key, tie, ts, millis(events, ts).alias("_ms"))
        .groupBy(key)
        .applyInPandasWithState(
            step, out, f"lag double, last double, times array<double>, ties array<{types[tie]}>", "append", GroupStateTimeout.EventTimeTimeout
        )
    )
