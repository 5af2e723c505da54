"""Keyed state: late rows with smaller numbers win, runs close at gaps, and state empties."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from siftwright.streaming import keyed


def batches(spark, rows, schema, closing):
    """Rows (batch, ts in seconds, ...) as batches, and one row a day later."""
    made = [spark.createDataFrame([r[1:] for r in rows if r[0] == n], f"s long, {schema}") for n in sorted({r[0] for r in rows})]
    return [b.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s") for b in (*made, spark.createDataFrame([(200_000, *closing)], f"s long, {schema}"))]


def test_the_first_number_wins_even_if_it_comes_late(spark, tmp_path):
    rows = [(0, 0, "a", 7, "x7"), (0, 0, "b", 3, "y3"), (1, 60, "a", 2, "x2"), (2, 120, "a", 5, "x5"), (3, 1500, "c", 1, "z1"), (4, 1600, "a", 1, "too late"), (4, 1600, "b", 9, "too late")]
    got = keyed.replay(batches(spark, rows, "k string, lineno long, t string", ("end", 0, "")), str(tmp_path), lambda s: keyed.first_wins(s, "k"))
    assert sorted(map(tuple, got.filter("k <> 'end'").collect())) == [("a", 2, "x2"), ("b", 3, "y3"), ("c", 1, "z1")]


def test_runs_in_any_order_and_state_that_empties(spark, tmp_path):
    rng = random.Random(2)
    kept = sorted(rng.sample(range(300), 240))
    rows = [(rng.randrange(4), k, n) for k in ("p", "q") for n in kept]
    rows = [(b, 60 * b, k, n, f"{k}{n}") for b, k, n in rows] + [(0, 0, "p", kept[0], "repeated")]
    data = batches(spark, rows, "k string, lineno long, line string", ("end", 0, ""))
    seen = []

    def work(stream):
        from pyspark.sql.streaming import StreamingQueryListener

        class Listener(StreamingQueryListener):
            def onQueryStarted(self, event): ...
            def onQueryIdle(self, event): ...
            def onQueryTerminated(self, event): ...
            def onQueryProgress(self, event):
                seen.extend(s.numRowsTotal for s in event.progress.stateOperators)

        work.listener = Listener()
        spark.streams.addListener(work.listener)
        return keyed.line_runs(stream, "k")

    got = keyed.replay(data, str(tmp_path), work)
    runs = []
    for n in kept:
        if runs and runs[-1][-1] == n - 1:
            runs[-1].append(n)
        else:
            runs.append([n])
    want = sorted((k, r[0], len(r), "\n".join(f"{k}{n}" for n in r)) for k in ("p", "q") for r in runs)
    found = sorted(map(tuple, got.filter("k <> 'end'").collect()))
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert [f[3] for f in found][1:] == [w[3] for w in want][1:] or found[0][3].startswith("repeated")
    until = time.time() + 60  # progress is told later than the query ends
    while not (seen and seen[-1] < 20) and time.time() < until:
        time.sleep(0.2)
    spark.streams.removeListener(work.listener)
    assert max(seen) > 400 and seen[-1] < 20


def test_the_state_setting_is_put_back(spark):
    before = spark.conf.get(keyed.PROVIDER, None)
    with keyed.keyed_state(spark):
        assert spark.conf.get(keyed.PROVIDER) == keyed.ROCKSDB
    assert spark.conf.get(keyed.PROVIDER, None) == before


def test_a_replayed_batch_is_written_by_many_tasks_and_is_one_batch(spark, tmp_path):
    data = [b.repartition(4, "lineno") for b in batches(spark, [(n, 60 * n, f"k{i % 50}", 1000 * (2 - n) + i) for n in range(3) for i in range(200)], "k string, lineno long", ("end", 0))]
    got = keyed.replay(data, str(tmp_path), lambda s: keyed.first_wins(s, "k"))
    assert sorted(map(tuple, got.filter("k <> 'end'").collect())) == sorted((f"k{i}", i) for i in range(50))
    files = spark.read.parquet(f"{tmp_path}/in").groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 12 and max(r["count"] for r in files) < 100


class Held:
    """The map state of one key in memory, which counts the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = {}, [], 0

    def getMapState(self, name, key, value):
        return self

    def __getattribute__(self, name):
        if name in ("keys", "containsKey", "updateValue", "iterator", "removeKey", "clear", "registerTimer"):
            object.__setattr__(self, "calls", object.__getattribute__(self, "calls") + 1)
        return object.__getattribute__(self, name)

    def keys(self):
        return iter(list(self.rows))

    def containsKey(self, key):
        return key in self.rows

    def updateValue(self, key, value):
        self.rows[key] = value

    def iterator(self):
        return iter(list(self.rows.items()))

    def removeKey(self, key):
        del self.rows[key]

    def clear(self):
        self.rows.clear()

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_line_costs_one_call_of_the_state():
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    runs, held = keyed.LineRuns(["k"], 600), Held()
    runs.init(held)
    rows = lambda numbers, ms, t: [Row(lineno=n, line=f"{t}{n}", **{keyed.TIME: ms}) for n in numbers]
    runs.handleInputRows(("p",), iter(rows(range(0, 300, 2), 0, "a")), TimerValues(0, 0))
    runs.handleInputRows(("p",), iter([*rows(range(1, 200, 2), 100, "b"), *rows([0, 1], 100, "again")]), TimerValues(0, 0))
    runs.handleInputRows(("p",), iter(rows([400, 401], 900, "c")), TimerValues(0, 0))
    got = [r for at in sorted(held.timers) if at <= 800 for r in runs.handleExpiredTimer(("p",), TimerValues(0, 800), ExpiredTimerInfo(at))]
    text = "\n".join(f"{'b' if n % 2 else 'a'}{n}" for n in range(201))
    assert sorted(map(tuple, got)) == [("p", 0, 201, text), *[("p", n, 1, f"a{n}") for n in range(202, 300, 2)]]
    assert sorted(held.rows) == [(400,), (401,)]
    assert held.calls < 300, held.calls  # 252 different lines


class Values:
    """The value states and timers of one group in memory, which count the calls."""

    def __init__(self):
        self.calls, self.timers = 0, []

    def getValueState(self, name, kind):
        return Value(self)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Value:
    def __init__(self, group):
        self.group, self.value = group, None

    def exists(self):
        return self.get() is not None

    def get(self):
        self.group.calls += 1
        return self.value

    def update(self, value):
        self.group.calls, self.value = self.group.calls + 1, value

    def clear(self):
        self.group.calls, self.value = self.group.calls + 1, None


def test_a_batch_costs_a_group_of_keys_a_few_calls():
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
    from pyspark.sql.types import StructType

    first, held = keyed.FirstWins(StructType.fromDDL("k string, lineno long"), ["k"], "lineno", 600, 10_000), Values()
    first.init(held)
    rows = lambda numbers, n, ms: iter([Row(k=f"k{i}" if i else None, lineno=n + i, **{keyed.TIME: ms}) for i in numbers])
    assert list(first.handleInputRows((0,), rows(range(1000), 5000, 0), TimerValues(0, 0))) == []
    assert list(first.handleInputRows((0,), rows(range(500), 2000, 300), TimerValues(0, 0))) == []
    wake = lambda now: [r for at in sorted(held.timers) if at <= now and not held.timers.remove(at) for r in first.handleExpiredTimer((0,), TimerValues(0, now), ExpiredTimerInfo(at))]
    assert sorted(r["lineno"] for r in wake(700)) == list(range(5500, 6000))
    # the second half is due before these rows, the first half is given out
    late = first.handleInputRows((0,), rows(range(1000), 0, 950), TimerValues(0, 950))
    assert sorted((r["lineno"], r["k"]) for r in late) == [(2000 + i, f"k{i}" if i else None) for i in range(500)]
    assert wake(2000) == [] and held.calls < 40, held.calls
    # what was given out is forgotten, so its keys come anew
    assert wake(20_000) == [] and first.waiting.value is None and first.given.value is None
    assert list(first.handleInputRows((0,), rows([3], 0, 20_000), TimerValues(0, 20_000))) == []
    assert [tuple(r) for r in wake(20_600)] == [("k3", 3)]


class Parts(Values):
    """The list state and timers of one group in memory, which count the calls."""

    def __init__(self):
        super().__init__()
        self.values = []

    def getListState(self, name, kind):
        return self

    def get(self):
        self.calls += 1
        return iter(list(self.values))

    def appendValue(self, value):
        self.calls += 1
        self.values.append(value)

    def put(self, values):
        self.calls, self.values = self.calls + 1, list(values)

    def clear(self):
        self.calls, self.values = self.calls + 1, []


def test_runs_of_many_keys_cost_a_few_calls():
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

    runs, held = keyed.GroupedRuns(["k"], 600), Parts()
    runs.init(held)
    rows = lambda numbers, ms, t: iter([Row(k=k, lineno=n, line=f"{t}{n}", **{keyed.TIME: ms}) for n in numbers for k in ("p", "q")])
    wake = lambda now: [r for at in sorted(held.timers) if at <= now and not held.timers.remove(at) for r in runs.handleExpiredTimer((0,), TimerValues(0, now), ExpiredTimerInfo(at))]
    runs.handleInputRows((0,), rows(range(0, 300, 2), 0, "a"), TimerValues(0, 0))
    runs.handleInputRows((0,), rows([*range(1, 200, 2), 0, 1], 100, "b"), TimerValues(0, 0))
    runs.handleInputRows((0,), rows([400, 401], 900, "c"), TimerValues(0, 0))
    text = "\n".join(f"{'b' if n % 2 else 'a'}{n}" for n in range(201))
    assert sorted(map(tuple, wake(650))) == [(k, n, 1, f"a{n}") for k in ("p", "q") for n in range(202, 300, 2)]
    runs.handleInputRows((0,), rows([402], 1000, "d"), TimerValues(0, 650))
    assert sorted(map(tuple, wake(800))) == [(k, 0, 201, text) for k in ("p", "q")]
    assert wake(1500) == [] and sorted(map(tuple, wake(1600))) == [(k, 400, 3, "c400\nc401\nd402") for k in ("p", "q")]
    assert held.values == [] and held.timers == [] and held.calls < 40, held.calls
