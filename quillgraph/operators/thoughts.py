"""A small algebra over candidate states ("thoughts") and the graph that runs it.

A thought is a row (id, state map<string,string>, score double, valid boolean, scored boolean,
validated boolean).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "id string, state map<string,string>, score double, valid boolean, scored boolean, validated boolean, solved boolean"


def thoughts(df: DataFrame, id_col: str, state: Column) -> DataFrame:
    none = lambda kind: F.lit(None).cast(kind)
    return df.select(F.col(id_col).cast("string").alias("id"), state.alias("state"), none("double").alias("score"), none("boolean").alias("valid"), F.lit(False).alias("scored"), F.lit(False).alias("validated"), none("boolean").alias("solved"))


def score(t: DataFrame, value: Column) -> DataFrame:
    return t.withColumn("score", value.cast("double")).withColumn("scored", F.lit(True))


def validate(t: DataFrame, condition: Column) -> DataFrame:
    return t.withColumn("valid", F.coalesce(condition, F.lit(False))).withColumn("validated", F.lit(True))


def merge_states(base: Column, new: Column) -> Column:
    """``new`` over ``base``."""
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(new, k)), new)


def generate(t: DataFrame, new_states: Column) -> DataFrame:
    """One thought per element of an array of state maps, over the old state."""
    rows = t.select("id", "state", F.posexplode(new_states).alias("_n", "_new"))
    return thoughts(rows.withColumn("_id", F.concat_ws(".", "id", F.col("_n").cast("string"))), "_id", merge_states(F.col("state"), F.col("_new")))


def improve(t: DataFrame, new_state: Column) -> DataFrame:
    return t.withColumn("state", merge_states(F.col("state"), new_state))


def validate_and_improve(t: DataFrame, condition: Column, new_state: Column, tries: int = 3) -> DataFrame:
    """Invalid thoughts are improved and validated again, at most ``tries`` times; the last state stays."""
    out = validate(t, condition)
    for _ in range(tries - 1):
        out = validate(out.withColumn("state", F.when(F.col("valid"), F.col("state")).otherwise(merge_states(F.col("state"), new_state))), condition)
    return out


def aggregate(t: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, state): states folded by rising score, later ones over earlier ones.

    The last value of every entry is folded as rows come, so no row holds the states of a group. Of
    equal scores and ids the greater entries are later; a null state has none.
    """
    place = F.struct(F.coalesce("score", F.lit(0.0)).alias("s"), "id", F.map_entries("state").alias("e"))
    rows = t.select(*keys, F.posexplode_outer("state").alias("_i", "_k", "_v"), place.alias("_at"))
    last = rows.groupBy(*keys, "_k").agg(F.max(F.struct("_at", "_i", "_v")).alias("_m"))
    entry = F.when(F.col("_k").isNotNull(), F.struct("_m._at", "_m._i", F.struct(F.col("_k").alias("key"), F.col("_m._v").alias("value")).alias("e")))
    entries = F.array_sort(F.collect_list(entry))
    return last.groupBy(*keys).agg(F.map_from_entries(F.transform(entries, lambda x: x["e"])).alias("state"))


def keep_best(t: DataFrame, n: int, higher_is_better: bool = True) -> DataFrame:
    """The n thoughts of best score, ties to the smaller id; unscored thoughts are an error."""
    checked = t.withColumn("score", F.when(F.col("scored"), F.col("score")).otherwise(F.raise_error(F.lit("a thought is not scored")).cast("double")))
    return checked.orderBy(F.desc("score") if higher_is_better else F.asc("score"), "id").limit(n)


def keep_valid(t: DataFrame) -> DataFrame:
    """Thoughts that are valid or were never validated."""
    return t.where("not validated or valid")


def ground_truth(t: DataFrame, solved: Column) -> DataFrame:
    """A comparison that fails counts as false."""
    return t.withColumn("solved", F.coalesce(solved, F.lit(False)))


def select(t: DataFrame, chooser: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return chooser(t)


@dataclass
class Step:
    """A named operation over the union of its predecessors' thoughts."""

    name: str
    run: Callable[[DataFrame], DataFrame]
    after: list[str] = field(default_factory=list)


@dataclass
class ThoughtGraph:
    """Steps run once all predecessors have; results are kept by name."""

    steps: list[Step] = field(default_factory=list)

    def append(self, name: str, run: Callable[[DataFrame], DataFrame]) -> ThoughtGraph:
        """Add a step after all steps that have no successor."""
        used = {a for s in self.steps for a in s.after}
        self.steps.append(Step(name, run, [s.name for s in self.steps if s.name not in used]))
        return self

    def execute(self, start: DataFrame) -> dict[str, DataFrame]:
        done: dict[str, DataFrame] = {}
        waiting = list(self.steps)
        while waiting:
            ready = [s for s in waiting if all(a in done for a in s.after)]
            if not ready:
                raise ValueError("the steps depend on each other in a circle")
            for s in ready:
                source = start if not s.after else None
                for a in s.after:
                    source = done[a] if source is None else source.unionByName(done[a], allowMissingColumns=True)
                done[s.name] = s.run(source)
                waiting.remove(s)
        return done


def ranked(t: DataFrame) -> DataFrame:
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "id")))
