"""Stateful operators, as batch windows and folds and, where state is kept between records, as streaming functions.

The batch forms carry an explicit total order, so a batch equals a stream run over the same records.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Throttle, pending frames, moving average, quality control, click and double-click times.
INTERVAL_MS, MOST_PENDING, AVERAGED = 40, 3, 20
LOWER_ABOVE, RAISE_BELOW, QUALITY = 0.5, 0.4, (10, 100)
CLICK_MS, DOUBLE_MS, LONG_AGO_MS, LEFT = 300, 500, 10_000, 1


def latest(frames: DataFrame, key: list[str], number: str) -> DataFrame:
    """The newest frame of each key."""
    others = [c for c in frames.columns if c not in key]
    return frames.groupBy(*key).agg(F.max_by(F.struct(*others), number).alias("f")).select(*key, "f.*")


def folded(rows: DataFrame, key: list[str], order: list[str], columns: list[str], schema: str, begin: Callable[[], list], step: Callable[[list, pd.DataFrame], list[tuple]], finish: Callable[[list], list[tuple]]) -> DataFrame:
    """A fold over each key's rows in their order that can't be said in windows: key and the fields that step and finish return.

    Rows come sorted, batch by batch, and only the state of one key is held, however long its history is.
    """
    kinds = dict(rows.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, begin()
        names = [*key, *(f.split()[0] for f in schema.split(","))]
        for df in frames:
            out: list[tuple] = []
            if len(df):
                keys = df[key].astype(object).where(df[key].notna(), None)
                cut = np.flatnonzero((keys != keys.shift()).to_numpy().any(axis=1) | (np.arange(len(df)) == 0))
                for a, z in zip(cut, np.append(cut[1:], len(df)), strict=True):
                    k = tuple(keys.iloc[a])
                    if k != now:
                        if now is not None:
                            out += [(*now, *r) for r in finish(state)]
                        now, state = k, begin()
                    out += [(*k, *r) for r in step(state, df.iloc[a:z])]
            if out:
                yield pd.DataFrame(out, columns=names)
        if now is not None and (out := [(*now, *r) for r in finish(state)]):
            yield pd.DataFrame(out, columns=names)

    used = list(dict.fromkeys([*key, *order, *columns]))
    return rows.select(*used).repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), schema]))


def throttled(events: DataFrame, key: list[str], ms: str, interval: int = INTERVAL_MS) -> DataFrame:
    """Events that a sender lets through: at least ``interval`` after the last one sent."""

    def step(state: list, df: pd.DataFrame) -> list[tuple]:
        t = df[ms].to_numpy()
        at, out = 0 if state[0] is None else int(np.searchsorted(t, state[0] + interval)), []
        while at < len(t):
            state[0] = int(t[at])
            out.append((state[0],))
            at = int(np.searchsorted(t, state[0] + interval))
        return out

    return folded(events.where(F.col(ms).isNotNull()).withColumn(ms, F.col(ms).cast("long")), key, [ms], [ms], f"{ms} bigint", lambda: [None], step, lambda state: [])


def pending(events: DataFrame, key: list[str], order: list[str], kind: str, number: str, most: int = MOST_PENDING) -> DataFrame:
    """Ticks of a sender ('send') and acknowledgements ('ack', of the frame ``number``) per client: sent, skipped, confirmed.

    Frames are numbered from 0 as they are sent. An acknowledgement confirms all frames up to its number, and replaces
    what was confirmed before; a tick is skipped while the confirmed number (-1 at first) is ``most`` or more behind
    that of the next frame.
    """

    def step(state: list, df: pd.DataFrame) -> list[tuple]:
        for what, n in zip(df[kind].tolist(), df[number].tolist(), strict=True):
            if what == "ack" and n is not None and n == n:
                state[2] = int(n)
            elif what == "send":
                state[1 if state[2] + most <= state[0] else 0] += 1
        return []

    return folded(events, key, order, [kind, number], "sent bigint, skipped bigint, confirmed bigint", lambda: [0, 0, -1], step, lambda state: [tuple(state)])


def moving_average(rows: DataFrame, key: list[str], order: list[str], value: str, n: int = AVERAGED) -> DataFrame:
    """Mean of the last n values, those before the first counting as 0."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("average", F.sum(value).over(w) / n)


#: Samples of one client that are folded as one array.
PIECE = 4096


def adaptive_quality(rows: DataFrame, key: list[str], order: list[str], value: str, start: int = 50) -> DataFrame:
    """The quality after all of a client's samples: one down while the moving average is high, one up while it is low.

    A step is a shift between two bounds, and so is any number of steps in a row: a client's samples are folded in
    pieces of bounded size, and then the pieces.
    """
    averages = moving_average(rows, key, order, value)
    number = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    shift = F.when(F.col("average") > LOWER_ABOVE, -1).when(F.col("average") < RAISE_BELOW, 1).otherwise(0)
    low, high = (F.lit(q) for q in QUALITY)
    cut = lambda x: F.greatest(low, F.least(high, x))
    whole = F.struct(F.lit(0).alias("s"), F.lit(-(1 << 30)).alias("lo"), F.lit(1 << 30).alias("hi"))
    moved = lambda f, d: F.struct((f["s"] + d).alias("s"), cut(f["lo"] + d).alias("lo"), cut(f["hi"] + d).alias("hi"))
    pieces = averages.select(*key, number.alias("_n"), shift.alias("_d")).withColumn("_p", F.floor(F.col("_n") / PIECE))
    pieces = pieces.groupBy(*key, "_p").agg(F.sort_array(F.collect_list(F.struct("_n", "_d"))).alias("_l"))
    pieces = pieces.select(*key, "_p", F.aggregate("_l", whole, lambda f, x: moved(f, x["_d"])).alias("_f"))
    by = pieces.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_p", "_f"))).alias("_l"))
    after = F.aggregate("_l", F.lit(start), lambda q, x: F.greatest(x["_f"]["lo"], F.least(x["_f"]["hi"], q + x["_f"]["s"])))
    return by.select(*key, after.alias("quality"))


def adaptive_quality_stream(stream: DataFrame, key: str, value: str, start: int = 50, order: tuple[str, ...] = ("order",)) -> DataFrame:
    """The same kept as state between micro-batches: the last values and the quality. Each batch's samples count in their order.

    An average near a limit hangs on the order of addition: values are added from the oldest on, as the window adds them.
    """
    before = AVERAGED - 1

    def update(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, quality = state.get if state.exists else ([None] * before, start)
        # a key's rows of one micro-batch come in any number of frames, and only together in their order
        df = pd.concat(list(frames)).sort_values(list(order), kind="stable")
        none = np.concatenate([[v is None for v in last], df["_none"].to_numpy(bool)])
        x = np.where(none, 0.0, np.concatenate([[0.0 if v is None else v for v in last], df[value].to_numpy(float)]))
        total, some = np.zeros(len(df)), np.zeros(len(df), bool)
        for j in range(AVERAGED):
            total += x[j : j + len(df)]
            some |= ~none[j : j + len(df)]
        average = total / AVERAGED
        # no value at all is no average, and NaN is above all
        for d in np.where(~some, 0, np.where(average < RAISE_BELOW, 1, np.where(average <= LOWER_ABOVE, 0, -1))).tolist():
            quality = max(QUALITY[0], min(QUALITY[1], quality + d))
        state.update(([None if n else v for n, v in zip(none[-before:].tolist(), x[-before:].tolist(), strict=True)], quality))
        yield pd.DataFrame({key: [k[0]], "quality": [quality]})

    kind = dict(stream.dtypes)[key]
    rows = stream.select(key, *order, value, F.col(value).isNull().alias("_none"))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, quality int", "last array<double>, quality int", "update", "NoTimeout")


def changed_only(rows: DataFrame, key: list[str], order: list[str], number: str) -> DataFrame:
    """Records whose number differs from the one before."""
    before = F.lag(number).over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(number))).drop("_b")


def dispatched(messages: DataFrame, text: str) -> DataFrame:
    """Client messages by protocol: kind and argument. Unknown ones are 'unknown'."""
    m = F.col(text)
    kind = F.when(m.startswith("s:"), "subscribe").when(m.startswith("n:"), "ack").when(m == "F", "full").when(m.isin("B", "T"), "format").otherwise("unknown")
    argument = F.when(kind.isin("subscribe", "ack"), F.substring(m, 3, 1 << 30)).when(kind == "format", F.when(m == "B", "binary").otherwise("text"))
    return messages.select("*", kind.alias("kind"), argument.alias("argument"))


def clicks(events: DataFrame, key: list[str], order: list[str], ms: str, flags: str) -> DataFrame:
    """Releases of the left button that are clicks, double clicks or both: the events with ``click`` and ``double_click``.

    flags: the buttons and keys held (LEFT: the left button alone). A release is a click soon after its press, and a
    double click soon after the press before that one, however long the second press was. Any other button or key
    in between makes both presses void.
    """
    w = Window.partitionBy(*key).orderBy(*order)
    now, before = F.coalesce(F.col(flags), F.lit(0)), F.coalesce(F.lag(flags).over(w), F.lit(0))
    rows = events.withColumn("_press", (before == 0) & (now == LEFT)).withColumn("_release", (before == LEFT) & (now == 0))
    rows = rows.withColumn("_void", F.sum(F.when((now != 0) & (now != LEFT), 1).otherwise(0)).over(w))
    own = Window.partitionBy(*key, "_void").orderBy(*order)
    rows = rows.withColumn("_at", F.when(F.col("_press"), F.col(ms)))
    rows = rows.withColumn("_last", F.last("_at", ignorenulls=True).over(own))
    earlier = F.last("_at", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_first", F.last(F.when(F.col("_press"), F.coalesce(earlier, F.col(ms) - LONG_AGO_MS)), ignorenulls=True).over(own))
    soon = lambda since, limit: F.coalesce(F.col(ms) - F.col(since) < limit, F.lit(False))
    rows = rows.where("_release").withColumn("click", soon("_last", CLICK_MS)).withColumn("double_click", soon("_first", DOUBLE_MS))
    return rows.where("click or double_click").drop("_press", "_release", "_void", "_at", "_last", "_first")


def drag(events: DataFrame, key: list[str], order: list[str], names: list[str]) -> DataFrame:
    """Differences to the state before of the same button."""
    w = Window.partitionBy(*key).orderBy(*order)
    return events.select("*", *((F.col(n) - F.lag(n).over(w)).alias(f"d_{n}") for n in names))


def sessions(events: DataFrame, key: str, ts: str, interval_s: float) -> DataFrame:
    """Keep-alive sessions: one ends if nothing comes for 1.5 intervals. Works on streams too."""
    gap = f"{int(interval_s * 1500)} milliseconds"
    return events.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def change_flags(rows: DataFrame, key: list[str], order: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """Which groups of properties changed against the record before: one bit for each group; all at the first."""
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(w) == 1
    flags = F.lit(0)
    for i, names in enumerate(groups.values()):
        same = None
        for n in names:
            s = F.lag(n).over(w).eqNullSafe(F.col(n))
            same = s if same is None else same & s
        flags = flags + F.when(first | ~same, 1 << i).otherwise(0)
    return rows.withColumn("flags", flags)


def total_changes(flagged: DataFrame, key: list[str]) -> DataFrame:
    return flagged.groupBy(*key).agg(F.bit_or("flags").alias("flags"))


class Restartable:
    """Runs jobs in a group of their own; a change cancels what runs and starts anew."""

    def __init__(self, spark, name: str):
        self.sc, self.name, self.number = spark.sparkContext, name, 0

    def restart(self, job):
        """Cancel the running job, and call ``job`` in the next group."""
        self.sc.cancelJobGroup(f"{self.name}-{self.number}")
        self.number += 1
        self.sc.setJobGroup(f"{self.name}-{self.number}", self.name, True)
        return job()
