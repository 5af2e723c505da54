"""Order in keyed state: on a stream, the first line number of a key wins even if it comes late, and lines that follow
each other become runs in whatever order they come.

Both keep rows in state until the watermark is `delay` beyond the last of them, then give them out and forget them; a
timer of the event time wakes each key or group of keys. So state is bounded by what comes within the delay, and for the
first of a key by a mark of its key and a time for as long as copies are to be known.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIME = "_ms"
#: Groups that the keys of a stream are dealt to.
GROUPS = 2048


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams that are started inside keep their state in the store that timers need."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


class FirstWins(StatefulProcessor):
    """Of each key's rows the one with the least number, once no row of it came for `delay`; later copies are dropped.

    Every call of the state is a message to the JVM, so keys are dealt to groups that share a state: a group's waiting
    rows are one value, its marks another, and one timer wakes it. A batch costs a group a few calls, however many keys.
    """

    def __init__(self, fields: StructType, keys: list[str], order: str, delay: int, remember: int):
        self.names, self.order, self.delay, self.remember = fields.names, fields.names.index(order), delay, remember
        self.keys = [fields.names.index(k) for k in keys]

    def init(self, handle) -> None:
        self.handle = handle
        kind = StructType([StructField("wake", LongType()), StructField("rows", BinaryType())])
        self.waiting, self.given = handle.getValueState("waiting", kind), handle.getValueState("given", kind)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return self._run(rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self._run(iter([]), timerValues.getCurrentWatermarkInMs())

    def _run(self, rows: Iterator[Row], now: int) -> Iterator[Row]:
        (next_row, waiting), (next_mark, given) = self._load(self.waiting), self._load(self.given)
        due = [k for k, (at, _) in waiting.items() if at <= now]  # before the rows of this batch, which came too late for them
        out = []
        for k in due:
            at, row = waiting.pop(k)
            out.append(Row(**dict(zip(self.names, row, strict=True))))
            given[k] = at + self.remember
        old = [k for k, until in given.items() if until <= now]
        for k in old:
            del given[k]
        came = False
        for row in rows:
            own = tuple(row[c] for c in self.names)
            k = tuple(own[i] for i in self.keys)
            if k not in given:
                at, best = waiting.get(k, (0, own))
                waiting[k] = max(at, row[TIME] + self.delay), own if own[self.order] < best[self.order] else best
                came = True
        row_at = self._store(self.waiting, waiting, min((at for at, _ in waiting.values()), default=None)) if due or came else next_row
        mark_at = self._store(self.given, given, min(given.values(), default=None)) if due or old else next_mark
        self._wake(min(filter(None, (next_row, next_mark)), default=None), min(filter(None, (row_at, mark_at)), default=None), now)
        return iter(out)

    def _load(self, state) -> tuple[int | None, dict]:
        found = state.get()
        return (None, {}) if found is None else (found[0], pickle.loads(found[1]))

    def _store(self, state, rows: dict, wake: int | None) -> int | None:
        state.update((wake, pickle.dumps(rows, pickle.HIGHEST_PROTOCOL))) if rows else state.clear()
        return wake

    def _wake(self, before: int | None, at: int | None, now: int) -> None:
        if before != at:
            if before is not None and before > now:  # what is due goes by itself
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)

    def close(self) -> None:
        pass


class LineRuns(StatefulProcessor):
    """Maximal runs of lines whose numbers follow each other; a run ends when neither end of it grew for `delay`.

    Every call of the state is a message to the JVM, so the numbers that a key has are asked for once a batch, and what
    is due goes all at once.
    """

    def __init__(self, names: list[str], delay: int):
        self.names, self.delay = names, delay

    def init(self, handle) -> None:
        self.handle = handle
        self.lines = handle.getMapState("lines", StructType([StructField("lineno", LongType())]), StructType([StructField("line", StringType()), StructField("ms", LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        wakes, held = set(), {k[0] for k in self.lines.keys()}
        for row in rows:
            if row["lineno"] not in held:
                held.add(row["lineno"])
                self.lines.updateValue((row["lineno"],), (row["line"], row[TIME]))
                wakes.add(row[TIME] + self.delay)
        for at in wakes:
            self.handle.registerTimer(at)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = sorted((k[0], v[0], v[1]) for k, v in self.lines.iterator())
        # all that is due goes with the first timer, so the key's other timers of this batch find nothing
        now, out, gone, left, run = timerValues.getCurrentWatermarkInMs(), [], [], [], []
        for item in [*held, None]:
            if run and (item is None or item[0] != run[-1][0] + 1):
                if max(ms for *_, ms in run) + self.delay <= now:
                    out.append(Row(**dict(zip(self.names, key, strict=True)), first_line=run[0][0], n_lines=len(run), text="\n".join(line for _, line, _ in run)))
                    gone += run
                else:
                    left += run
                run = []
            if item is not None:
                run.append(item)
        if len(gone) > len(left):
            self.lines.clear()
            for lineno, line, ms in left:
                self.lines.updateValue((lineno,), (line, ms))
        else:
            for lineno, *_ in gone:
                self.lines.removeKey((lineno,))
        return iter(out)

    def close(self) -> None:
        pass


class GroupedRuns(StatefulProcessor):
    """The runs of LineRuns for many keys of few lines each, dealt to groups that share a state.

    What a batch brings to a group is appended to its list as one value; what is due is looked for when a timer of the
    group fires. So a batch costs a group a few calls, however many keys and lines it has.
    """

    def __init__(self, names: list[str], delay: int):
        self.names, self.delay = names, delay

    def init(self, handle) -> None:
        self.handle, self.done = handle, {}
        self.parts = handle.getListState("parts", StructType([StructField("lines", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came: dict[tuple, list[tuple]] = {}
        for row in rows:
            came.setdefault(tuple(row[c] for c in self.names), []).append((row["lineno"], row["line"], row[TIME]))
        if came:
            self.parts.appendValue((pickle.dumps(came, pickle.HIGHEST_PROTOCOL),))
            self.handle.registerTimer(min(ms for lines in came.values() for *_, ms in lines) + self.delay)
        self.done.pop(key, None)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        if self.done.get(key) == now:  # the group's other timers of this batch find nothing new
            return iter([])
        self.done[key] = now
        held: dict[tuple, dict[int, tuple]] = {}
        for (part,) in self.parts.get():
            for k, lines in pickle.loads(part).items():
                own = held.setdefault(k, {})
                for item in lines:
                    own.setdefault(item[0], item)  # of a repeated number the first line stays
        out, left, wake = [], {}, None
        for k, own in held.items():
            for run in self._runs(own):
                at = max(ms for *_, ms in run) + self.delay
                if at <= now:
                    out.append(Row(**dict(zip(self.names, k, strict=True)), first_line=run[0][0], n_lines=len(run), text="\n".join(line for _, line, _ in run)))
                else:
                    left.setdefault(k, []).extend(run)
                    wake = at if wake is None else min(wake, at)
        if out and left:
            self.parts.put([(pickle.dumps(left, pickle.HIGHEST_PROTOCOL),)])
        elif out:
            self.parts.clear()
        if wake is not None:
            self.handle.registerTimer(wake)
        return iter(out)

    @staticmethod
    def _runs(lines: dict[int, tuple]) -> Iterator[list[tuple]]:
        run: list[tuple] = []
        for n in sorted(lines):
            if run and n != run[-1][0] + 1:
                yield run
                run = []
            run.append(lines[n])
        if run:
            yield run

    def close(self) -> None:
        pass


def _timed(rows: DataFrame, time_col: str, delay: str) -> DataFrame:
    return rows.withColumn(TIME, F.unix_millis(time_col)).withWatermark(time_col, delay)


def first_wins(rows: DataFrame, *keys: str, order: str = "lineno", time_col: str = "ts", delay_ms: int = 600_000, remember_ms: int = 86_400_000, groups: int = GROUPS) -> DataFrame:
    """The row with the least `order` of every key of a stream, given out when no row of the key came for the delay."""
    fields = StructType([f for f in rows.schema.fields if f.name != time_col])
    dealt = _timed(rows.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups))), time_col, "0 seconds")
    return dealt.groupBy("_group").transformWithState(FirstWins(fields, list(keys), order, delay_ms, remember_ms), fields, "Append", "EventTime")


def line_runs(rows: DataFrame, *keys: str, time_col: str = "ts", delay_ms: int = 600_000, groups: int | None = None) -> DataFrame:
    """(keys..., first_line, n_lines, text): runs of following line numbers of a stream (keys..., lineno, line, ts).

    Without groups each key has a state of its own, to which a batch writes single lines: for few keys that get lines for
    long. With them many keys share a state: for many keys of few lines, such as documents.
    """
    fields = StructType([*[rows.schema[k] for k in keys], StructField("first_line", LongType()), StructField("n_lines", LongType()), StructField("text", StringType())])
    if groups is None:
        return _timed(rows, time_col, "0 seconds").groupBy(*keys).transformWithState(LineRuns(list(keys), delay_ms), fields, "Append", "EventTime")
    dealt = _timed(rows.withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(groups))), time_col, "0 seconds")
    return dealt.groupBy("_group").transformWithState(GroupedRuns(list(keys), delay_ms), fields, "Append", "EventTime")


def replay(batches: list[DataFrame], path: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream gives that reads the batches one after the other and then ends; for tests and for old data.

    A batch is written by as many tasks as make it. The stream goes on from its checkpoint for each batch and takes all
    files that are new, so they are one batch of it however many they are.
    """
    spark = batches[0].sparkSession
    for n, batch in enumerate(batches):
        batch.write.mode("append" if n else "overwrite").parquet(f"{path}/in")
        made = work(spark.readStream.schema(batches[0].schema).parquet(f"{path}/in"))
        with keyed_state(spark):
            run = made.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
            run.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{path}/out")
