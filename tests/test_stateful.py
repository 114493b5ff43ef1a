"""A bucket of keys is judged in one call, by the rows and the state of each of its keys alone."""

import datetime
import random
from types import SimpleNamespace

import pandas as pd

from gatehouse.sources.store import read_table
from gatehouse.streaming import stateful, streams

DAY = datetime.datetime(2024, 1, 1)
HOUR = 3_600_000
ACTIONS = {"activate": ("Draft", "Active"), "archive": ("Active", "Archived"), "restore": ("Archived", "Active")}


class Kept(dict):
    """A bucket's map state."""

    def exists(self):
        return bool(self)

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self.get(key)

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(list(self.items()))


def started(processor):
    state, timers = Kept(), []
    processor.init(SimpleNamespace(getMapState=lambda *_: state, registerTimer=timers.append))
    return state, timers


def bucket(rows, columns):
    frame = pd.DataFrame(rows, columns=columns).assign(**{stateful._BUCKET: 7})
    return iter([frame.iloc[: len(frame) // 2], frame.iloc[len(frame) // 2 :]])


def test_many_keys_within_a_watermark_in_one_call():
    rng, delay = random.Random(3), 10 * HOUR
    processor = stateful._FirstWithin("ts", ["n"], delay)
    state, timers = started(processor)
    until, n = {}, 0
    start = int((DAY - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
    for batch in range(4):
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: start + 6 * HOUR * batch if batch else 0)
        watermark, rows = now.getCurrentWatermarkInMs(), []
        for _ in range(500):
            rows.append((f"={rng.randrange(300)}" if rng.random() < 0.95 else "", n := n + 1, DAY + datetime.timedelta(hours=6 * batch + rng.randint(-3, 9))))
        wanted = {}
        for name, number, ts in sorted(rows, key=lambda r: (r[2], r[1])):
            at = int((ts - datetime.datetime(1970, 1, 1)).total_seconds() * 1000)
            if at < watermark:
                wanted[number] = "late"
            elif until.get(name, 0) > watermark:
                wanted[number] = "repeated"
            else:
                wanted[number], until[name] = "first", at + delay
        found = list(processor.handleInputRows((7,), bucket(rows, [stateful._KEY, "n", "ts"]), now))
        assert len(found) == 1 and list(found[0].columns) == ["n", "ts", "verdict"]
        assert dict(zip(found[0]["n"], found[0]["verdict"])) == wanted
        processor._swept.clear()
        for timer in [t for t in timers if t <= watermark]:
            assert list(processor.handleExpiredTimer((7,), now, None)) == []
            timers.remove(timer)
        # Nothing is forgotten before its time, and every key is under a timer that comes at most a delay after it.
        assert {k: v for k, (v,) in ((k[0], v) for k, v in state.items()) if v > watermark} == {k: v for k, v in until.items() if v > watermark}
        assert all(any(v <= t < v + delay for t in timers) for (v,) in state.values() if v > watermark)
    assert len(timers) < 10


def test_many_datasets_in_one_call():
    rng = random.Random(4)
    processor = stateful._Lifecycle(["n"], "action", ACTIONS, "Draft")
    state, _ = started(processor)
    first = pd.DataFrame({stateful._KEY: ["=1", "=2", "=1"], "status": ["Archived", "Other", "Active"]})
    processor.handleInitialState((7,), first, None)
    states, n = {"=1": "Archived", "=2": "Other"}, 0
    for _ in range(3):
        rows, wanted = [(f"={rng.randrange(60)}" if rng.random() < 0.9 else "", n := n + 1, rng.choice([*ACTIONS, "other"])) for _ in range(200)], {}
        for name, number, action in rows:
            before = states.get(name, "Draft")
            needed, target = ACTIONS.get(action, (None, None))
            states[name] = target if needed == before else before
            wanted[number] = (before, needed == before, states[name])
        rng.shuffle(rows)
        found = list(processor.handleInputRows((7,), bucket(rows, [stateful._KEY, "n", "action"]), None))
        assert len(found) == 1
        assert {r.n: (r.state_before, r.accepted, r.state_after) for r in found[0].itertuples()} == wanted
    assert {name: status for (name,), (status,) in state.items()} == states


def test_null_and_odd_keys_have_texts_of_their_own(spark):
    rows = spark.createDataFrame([(None,), ("",), ("=",), ("a",)], "k string")
    dealt = stateful._dealt(rows, "k").collect()
    assert len({r[stateful._KEY] for r in dealt}) == 4
    assert all(0 <= r[stateful._BUCKET] < stateful.BUCKETS for r in dealt)
    binary = stateful._dealt(spark.createDataFrame([(b"\xff",), (b"\xfe",)], "k binary"), "k").collect()
    assert len({r[stateful._KEY] for r in binary}) == 2


def test_requests_without_a_dataset_leave_the_states_of_others_alone(spark, tmp_path):
    schema = "id long, n long, action string"
    rows = [(key, 2 * at + turn, ("activate", "archive")[turn]) for turn in range(2) for at, key in enumerate([None, *range(40)])]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    streams.lifecycle_stream(stream, "id", ["n"], str(tmp_path / "checkpoint"), str(tmp_path / "out")).awaitTermination()
    outcomes = read_table(spark, str(tmp_path / "out/outcomes")).collect()
    assert len(outcomes) == 82
    assert all((r["state_before"], r["accepted"]) == (("Draft", "Active")[r["n"] % 2], True) for r in outcomes)
