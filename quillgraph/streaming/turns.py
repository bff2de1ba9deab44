"""Question and answer groups of conversations as a stream: state for each conversation, timers, late turns."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quillgraph.functions.session import remove

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TOKEN = re.compile(r"\S+", re.A)
_OUT = Row("conv", "qa", "question", "answer", "role", "context", "late")
_GROUP = "qa long, question string, answer string, role string, context string, late boolean"


class TurnGroups(StatefulProcessor):
    """Groups of one conversation, given out as they close; its state is the open group and what waits for a gap.

    Turns are taken in order of their number: the next one at once, one beyond a gap waits in a map until the
    gap fills. A user turn closes the group before it. A conversation that is idle for ``idle_ms`` of event time
    is closed as it stands, gaps left; turns that follow go on with its numbers. A turn whose place is already
    closed, or that has no number, is given out as a late row. After ``forget_ms`` more its state goes.
    """

    def __init__(self, idle_ms: int, forget_ms: int, max_turns: int, budget: int):
        self.idle_ms, self.forget_ms, self.max_turns, self.budget = idle_ms, forget_ms, max_turns, budget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, qa long, open boolean, question string, role string, last long, timer long")
        self.answers = handle.getListState("answers", "text string")
        self.waiting = handle.getMapState("waiting", "turn long", "role string, text string")
        self.recent = handle.getValueState("recent", "lines array<string>")

    def _load(self) -> dict:
        found = self.place.get() if self.place.exists() else (0, 0, False, None, None, 0, 0)
        return dict(zip(("next", "qa", "open", "question", "role", "last", "timer"), found, strict=True))

    def _save(self, s: dict) -> None:
        self.place.update((s["next"], s["qa"], s["open"], s["question"], s["role"], s["last"], s["timer"]))

    def _schedule(self, s: dict, at: int) -> None:
        """The conversation's only timer: the end of its idle time or, once closed, the time to forget it."""
        if at != s["timer"]:
            if s["timer"]:
                self.handle.deleteTimer(s["timer"])
            self.handle.registerTimer(at)
            s["timer"] = at

    def _close(self, conv, s: dict) -> Iterator[Row]:
        """The open group, with the context of the groups up to it: latest first, within turns and tokens."""
        if not s["open"]:
            return
        answer = "\n".join(a[0] for a in self.answers.get() if a[0] is not None) if self.answers.exists() else ""
        lines = list(self.recent.get()[0]) if self.recent.exists() else []
        line = f"user|{s['question']}" + (f"\n{s['role']}|{answer}" if answer else "")
        lines = [line, *lines][: self.max_turns]
        self.recent.update((lines,))
        kept, spent = [], 0
        for x in lines:
            spent += len(_TOKEN.findall(x))
            if spent > self.budget:
                break
            kept.append(x)
        yield _OUT(conv, s["qa"], s["question"], answer, s["role"], "\n".join(kept), False)
        s.update(open=False, question=None, role=None)
        self.answers.clear()

    def _take(self, conv, s: dict, turn: int, role: str | None, text: str | None) -> Iterator[Row]:
        s["next"] = turn + 1
        if role == "user":
            yield from self._close(conv, s)
            s.update(open=True, qa=s["qa"] + 1, question=text)
        elif s["open"]:  # turns before the first question have no group
            if s["role"] is None:
                s["role"] = role
            self.answers.appendValue((text,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        conv, s = key[0], self._load()
        s["last"] = max(s["last"], timerValues.getCurrentWatermarkInMs())
        for r in rows:
            if r["turn"] is not None:  # a row without a number is no sign of life
                s["last"] = max(s["last"], r["at"] or 0)
            if r["turn"] is None or r["turn"] < s["next"]:
                user = r["role"] == "user"
                yield _OUT(conv, None, r["text"] if user else None, None if user else r["text"], r["role"], None, True)
            elif r["turn"] > s["next"]:
                self.waiting.updateValue((r["turn"],), (r["role"], r["text"]))
            else:
                yield from self._take(conv, s, r["turn"], r["role"], r["text"])
                while self.waiting.containsKey((s["next"],)):
                    turn = s["next"]
                    role, text = self.waiting.getValue((turn,))
                    self.waiting.removeKey((turn,))
                    yield from self._take(conv, s, turn, role, text)
        self._schedule(s, s["last"] + self.idle_ms)
        self._save(s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        conv, s = key[0], self._load()
        held = sorted(k[0] for k in self.waiting.keys())  # numbers only; texts are read one by one
        if not held and not s["open"]:
            for state in (self.place, self.answers, self.waiting, self.recent):
                state.clear()
            return
        for turn in held:
            role, text = self.waiting.getValue((turn,))
            self.waiting.removeKey((turn,))
            yield from self._take(conv, s, turn, role, text)
        yield from self._close(conv, s)
        s["timer"] = 0
        self._schedule(s, expiredTimerInfo.getExpiryTimeInMs() + self.forget_ms)
        self._save(s)

    def close(self) -> None:
        """Nothing is held outside the state."""


def turn_groups(
    stream: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    time: str = "ts",
    idle: int = 1800,
    delay: str = "10 minutes",
    forget: int = 30 * 86_400,
    max_turns: int = 5,
    budget: int = 8000,
) -> DataFrame:
    """(conv, qa, question, answer, role, context, late) of a stream of turns (conv, turn, role, text, time).

    Groups are those of ``qa_turns`` on the table of all turns, ``context`` is ``history_context`` as of the
    group. ``idle`` and ``forget`` are seconds of event time; Spark drops turns that come later than ``delay``
    behind the newest (it counts them in the query's progress), and all times up to the first moment of 1970. A null conversation is one like others; a null
    time counts as the watermark; a null text is an empty answer and a null question. Other columns are not read.
    """
    spark = stream.sparkSession
    if spark.conf.get(_STORE, None) != _ROCKS:  # timers and maps need it; running queries keep what they began with
        spark.conf.set(_STORE, _ROCKS)
    at = F.col(time).cast("timestamp")
    turns = stream.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), "role", "text", at.alias("ts"), F.unix_millis(at).alias("at")).withWatermark("ts", delay)
    kind = dict(stream.dtypes)[conv]
    made = turns.groupBy("conv").transformWithState(TurnGroups(1000 * idle, 1000 * forget, max_turns, budget), f"conv {kind}, {_GROUP}", "Append", "EventTime")
    return made.withColumnRenamed("conv", conv)


def write_turn_groups(groups: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append groups to a Parquet table, each once, also after a restart from ``checkpoint``."""
    writer = groups.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def replay(turns: DataFrame, folder: str, **how) -> DataFrame:
    """Groups of a table of turns, by way of the stream: a last turn, far ahead in time, closes all conversations.

    ``turns`` needs a column ``ts``; the folder holds the input, the groups and the checkpoint.
    """
    spark = turns.sparkSession
    rows = turns.select("conv_id", "turn", "role", "text", F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{folder}/in/turns")
    end = rows.agg(F.max("ts").alias("ts")).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes if c != "ts"], (F.coalesce("ts", F.lit(0).cast("timestamp")) + F.expr("interval 1 day")).alias("ts"))
    end.write.parquet(f"{folder}/in/end")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in/*")
    write_turn_groups(turn_groups(stream, **how), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    remove(spark, f"{folder}/in")
    return spark.read.parquet(f"{folder}/out")
