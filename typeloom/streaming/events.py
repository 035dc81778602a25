"""Event-stream operators, each as a batch form over a table and, where it needs state, as a form for streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def debounce(events: DataFrame, key: list[str], ts: str, gap: str, order: list[str] = ()) -> DataFrame:
    """The last event before each quiet period of ``gap`` or more."""
    by = Window.partitionBy(*key).orderBy(ts, *order)
    following = F.lead(ts).over(by)
    quiet = following.isNull() | (following >= F.col(ts) + F.expr(f"interval {gap}"))
    return events.withColumn("__q", quiet).filter("__q").drop("__q")


def debounce_stream(events: DataFrame, key: list[str], ts: str, gap: str, watermark: str = "1 minute") -> DataFrame:
    """Debounce of a stream: the last event of each session that ``gap`` of silence ends."""
    rest = [c for c in events.columns if c not in key]
    sessions = events.withWatermark(ts, watermark).groupBy(*key, F.session_window(ts, gap))
    return sessions.agg(F.max_by(F.struct(*rest), ts).alias("last")).select(*key, "last.*")


def distinct_until_changed(events: DataFrame, key: list[str], ts: str, value: str, order: list[str] = ()) -> DataFrame:
    """Events whose value differs from the one before."""
    before = F.lag(F.struct(value)).over(Window.partitionBy(*key).orderBy(ts, *order))
    return events.withColumn("__b", before).filter(F.col("__b").isNull() | ~F.col("__b")[value].eqNullSafe(F.col(value))).drop("__b")


def combine_latest(events: DataFrame, key: list[str], ts: str, sides: dict[str, object], order: list[str] = ()) -> DataFrame:
    """At every event the latest value of each side, once all have one. ``sides``: column by output name, null at other events."""
    by = Window.partitionBy(*key).orderBy(ts, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = events
    for name, column in sides.items():
        out = out.withColumn(name, F.last(column, ignorenulls=True).over(by))
    mine = F.lit(False)
    for column in sides.values():
        mine = mine | column.isNotNull()
    return out.filter(mine).dropna(subset=list(sides))


def skip_first(events: DataFrame, key: list[str], ts: str, n: int = 1, order: list[str] = ()) -> DataFrame:
    """Without the first ``n`` events of each key."""
    return events.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(ts, *order))).filter(F.col("__n") > n).drop("__n")


def merge(*streams: DataFrame) -> DataFrame:
    """All events of several streams, or of a table of initial values and its changes."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def _changed(value: str):
    def run(key, frames, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for row in frame.sort_values("__ts").to_dict("records"):
                if row[value] != last:
                    out.append(row)
                    last = row[value]
        state.update((last,))
        yield pd.DataFrame(out, columns=None if out else frame.columns)

    return run


def distinct_until_changed_stream(events: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """The stream's events whose value differs from their key's last; the state is one value a key."""
    from pyspark.sql import types as T
    from pyspark.sql.streaming.state import GroupStateTimeout

    rows = events.select(key, value, F.col(ts).alias("__ts"))
    state = T.StructType([T.StructField("last", rows.schema[value].dataType)])
    out = rows.groupBy(key).applyInPandasWithState(_changed(value), rows.schema, state, "append", GroupStateTimeout.NoTimeout)
    return out.withColumnRenamed("__ts", ts)


def _latest(names: list[str]):
    def run(key, frames, state):
        import pandas as pd

        held = list(state.get) if state.exists else [None] * len(names)
        out = []
        for frame in frames:
            for row in frame.sort_values("ts").to_dict("records"):
                held[names.index(row["side"])] = row["value"]
                if None not in held:
                    out.append((key[0], row["ts"], *held))
        state.update(tuple(held))
        yield pd.DataFrame(out, columns=["key", "ts", *names])

    return run


def combine_latest_stream(events: DataFrame, names: list[str]) -> DataFrame:
    """``(key, ts, side, value)`` to ``(key, ts, one column a side)``, once all sides of a key have a value."""
    from pyspark.sql import types as T
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = events.schema["value"].dataType
    columns = [T.StructField(n, kind) for n in names]
    schema = T.StructType([T.StructField("key", events.schema["key"].dataType), T.StructField("ts", events.schema["ts"].dataType), *columns])
    return events.groupBy("key").applyInPandasWithState(_latest(names), schema, T.StructType(columns), "append", GroupStateTimeout.NoTimeout)


def ingest(lines: DataFrame, engine, name: str, checkpoint: str, read: Callable[[DataFrame], DataFrame], finalize: bool = True):
    """Index a stream of definition lines in micro-batches; all that is there is read, then the index is finalized."""
    query = lines.writeStream.foreachBatch(lambda batch, _: engine.index(name, read(batch))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if finalize:
        engine.finalize(name)
    return query
