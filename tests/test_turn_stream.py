"""The stream of question and answer groups agrees with the table of turns, whatever order they come in."""

import datetime
import random

from pyspark.sql import functions as F

from quillgraph.operators import context as C
from quillgraph.streaming.turns import replay, turn_groups, write_turn_groups

SCHEMA = "conv_id long, turn long, role string, text string, ts timestamp, extra int"
BEGIN = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return BEGIN + datetime.timedelta(seconds=seconds)


def turn(conv, n, role, text, seconds=None):
    return (conv, n, role, text, at(n if seconds is None else seconds), 0)


def conversations(seed=5):
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        for n in range(rng.randrange(1, 14)):
            role = rng.choice(["user", "assistant", "system"])
            rows.append(turn(conv, n, role, " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 6)))))
    rng.shuffle(rows)
    return rows


def test_stream_over_restarts_equals_the_table(spark, tmp_path):
    rows = conversations()
    schema = spark.createDataFrame([], SCHEMA).schema

    def feed(part, name):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        write_turn_groups(turn_groups(stream, max_turns=3, budget=12), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()

    third = len(rows) // 3
    feed(rows[:third], "a")
    run()
    feed(rows[third : 2 * third], "b")
    feed(rows[2 * third :], "c")
    run()  # a new query, from the checkpoint
    feed([turn(None, None, None, None, 90_000)], "d")
    run()
    got = spark.read.parquet(f"{tmp_path}/out").where("not late")
    table = spark.createDataFrame(rows, SCHEMA)
    want = C.qa_turns(table, with_role=True)
    names = ["conv_id", "qa", "question", "answer", "role"]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(map(tuple, want.select(names).collect()), key=str)
    last = got.groupBy("conv_id").agg(F.max_by("context", "qa").alias("context")).where("context <> ''")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, C.history_context(table, 3, 12).select("conv_id", "context").collect()))


def test_gaps_late_turns_and_resumed_conversations(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    batches = [
        [turn(1, 0, "user", "q1", 0), turn(1, 2, "assistant", "a1", 1)],  # turn 1 is missing
        [turn(2, 0, "user", "other", 10_000)],  # conversation 1 is idle
        [turn(1, 1, "assistant", "lost", 10_001), turn(1, 3, "user", "q2", 10_002)],  # too late for its group; goes on
        [turn(3, 0, "system", "alone", 30_000)],
        [turn(None, None, None, None, 90_000)],
    ]
    for k, part in enumerate(batches):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        write_turn_groups(turn_groups(stream, idle=60, delay="1 second"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out").where("conv_id is not null").select("conv_id", "qa", "question", "answer", "late").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 1, "q1", "a1", False), (2, 1, "other", "", False), (1, None, None, "lost", True), (1, 2, "q2", "", False)], key=str)


def test_replay_of_empty_and_null_rows(spark, tmp_path):
    rows = [turn(None, 0, "user", None), turn(None, 1, "assistant", None), turn(7, None, "user", "nowhere", 1), (8, 0, "user", "", None, 0)]
    got = replay(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/a").collect()
    kept = sorted([(r.conv_id, r.qa, r.question, r.answer) for r in got if not r.late], key=str)
    assert kept == sorted([(8, 1, "", ""), (None, 1, None, "")], key=str)
    assert [(r.conv_id, r.question) for r in got if r.late and r.conv_id is not None] == [(7, "nowhere")]
    assert replay(spark.createDataFrame([], SCHEMA), f"{tmp_path}/b").where("not late").count() == 0
