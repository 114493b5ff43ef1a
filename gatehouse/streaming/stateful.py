"""Keyed state of streams: the lifecycle of a dataset, and the keys seen within a watermark.

The state of a key is a value of a few bytes in Spark's state store, which Spark checkpoints with the stream. A batch
reads and writes the state of its own keys only, however many keys there are. Keys are dealt to a fixed number of
buckets, and a bucket's rows of a batch are judged together: a call from Spark costs milliseconds, a key's state a
fraction of one.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, BooleanType, StringType, StructField, StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Buckets that the keys of a stream are dealt to; its checkpoint holds the state by bucket.
BUCKETS = 1024
_BUCKET, _KEY = "state_bucket", "state_key"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Keyed state needs the state store that keeps several values of a key; another setting is left alone."""
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKS_DB)


def _dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` with the bucket and the text of its key, which is empty for a null one."""
    text = F.base64(key) if isinstance(df.schema[key].dataType, BinaryType) else F.col(key).cast("string")
    keyed = df.withColumn(_KEY, F.coalesce(F.concat(F.lit("="), text), F.lit("")))
    return keyed.withColumn(_BUCKET, F.pmod(F.xxhash64(_KEY), F.lit(BUCKETS)).cast("int"))


def _in_order(rows: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    """A bucket's rows of one batch; the batch, bounded by its trigger, bounds them."""
    return pd.concat(list(rows), ignore_index=True).sort_values(list(order), kind="stable")


class _Lifecycle(StatefulProcessor):
    """The state of a dataset is its status."""

    def __init__(self, order: Sequence[str], action: str, transitions: dict[str, tuple[str, str]], start: str):
        self._order, self._action, self._transitions, self._start = tuple(order), action, transitions, start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._status = handle.getMapState("status", "key string", "status string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for name, status in zip(initialState[_KEY], initialState["status"]):
            if not self._status.containsKey((name,)):
                self._status.updateValue((name,), (status,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame, known = _in_order(rows, self._order), {}
        if self._status.exists():
            for name in frame[_KEY].unique():
                found = self._status.getValue((name,))
                if found is not None:
                    known[name] = found[0]
        statuses, before, accepted, after = dict(known), [], [], []
        for name, action in zip(frame[_KEY], frame[self._action]):
            status = statuses.get(name, self._start)
            needed, target = self._transitions.get(action, (None, None))
            before.append(status)
            accepted.append(needed == status)
            status = target if accepted[-1] else status
            statuses[name] = status
            after.append(status)
        for name, status in statuses.items():
            if name not in known or known[name] != status:
                self._status.updateValue((name,), (status,))
        yield frame.drop(columns=[_BUCKET, _KEY]).assign(state_before=before, accepted=accepted, state_after=after)

    def close(self) -> None:
        pass


def lifecycle(
    stream: DataFrame, key: str, order: Sequence[str], action: str, transitions: dict[str, tuple[str, str]], start: str,
    states: DataFrame | None = None,
) -> DataFrame:
    """Every request with the state it met, whether it was accepted, and the state after it.

    ``transitions`` maps an action to the state it needs and the one it leads to. A key begins as ``start``, or with its
    status in ``states(key, status)`` when the stream first starts. Requests must arrive in order between micro-batches,
    not within one. A dataset's state is never forgotten.
    """
    use_state_store(stream.sparkSession)
    schema = StructType([*stream.schema.fields, StructField("state_before", StringType()), StructField("accepted", BooleanType()),
                         StructField("state_after", StringType())])
    initial = _dealt(states.select(key, "status"), key).groupBy(_BUCKET) if states is not None else None
    return _dealt(stream, key).groupBy(_BUCKET).transformWithStateInPandas(
        _Lifecycle(order, action, transitions, start), schema, "Append", "None", initialState=initial)


#: What becomes of a row: the first of its key, a repetition of one that is remembered, or one behind the watermark.
FIRST, REPEATED, LATE = "first", "repeated", "late"


class _FirstWithin(StatefulProcessor):
    """The state of a key is the event time, in milliseconds, up to which its first row is remembered. Timers forget a
    bucket's keys, at most one for each ``delay_ms`` of event time, so that long after their time."""

    def __init__(self, time: str, order: Sequence[str], delay_ms: int):
        self._time, self._order, self._delay = time, (time, *order), delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle, self._swept = handle, set()
        self._until = handle.getMapState("until", "key string", "until bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _in_order(rows, self._order)
        watermark, verdicts = timerValues.getCurrentWatermarkInMs(), []
        known, changed, stored = {}, {}, self._until.exists()
        for name, at in zip(frame[_KEY], frame[self._time].astype("datetime64[ms]").astype("int64").tolist()):
            if at < watermark:
                verdicts.append(LATE)
                continue
            if name not in known:
                found = self._until.getValue((name,)) if stored else None
                known[name] = None if found is None else found[0]
            if known[name] is not None and known[name] > watermark:
                verdicts.append(REPEATED)
            else:
                verdicts.append(FIRST)
                known[name] = changed[name] = at + self._delay
        for name, until in changed.items():
            self._until.updateValue((name,), (until,))
        step = max(self._delay, 1)
        for moment in {-(-until // step) * step for until in changed.values()}:
            self._handle.registerTimer(moment)
        yield frame.drop(columns=[_BUCKET, _KEY]).assign(verdict=verdicts)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Several timers may have come to pass; one look at the bucket does for all.
        if key not in self._swept:
            self._swept.add(key)
            watermark = timerValues.getCurrentWatermarkInMs()
            for name in [name for name, until in self._until.iterator() if until[0] <= watermark]:
                self._until.removeKey(name)
        return iter([])

    def close(self) -> None:
        pass


def first_within(stream: DataFrame, key: str, time: str, order: Sequence[str], delay_ms: int) -> DataFrame:
    """Every row with ``verdict``: late behind the watermark, which follows the greatest event time of earlier batches by
    ``delay_ms``; repeated when the first row of its key is still remembered, which it is until the watermark has come
    ``delay_ms`` beyond it; else the first of its key. Event times count in milliseconds."""
    use_state_store(stream.sparkSession)
    watched = stream.withColumn("_event_time", F.col(time).cast("timestamp")).withWatermark("_event_time", f"{delay_ms} milliseconds")
    # Without its event-time column, Spark keeps late rows, and they get their verdict.
    rows = watched.drop("_event_time")
    schema = StructType([*stream.schema.fields, StructField("verdict", StringType())])
    return _dealt(rows, key).groupBy(_BUCKET).transformWithStateInPandas(_FirstWithin(time, order, delay_ms), schema, "Append", "EventTime")
