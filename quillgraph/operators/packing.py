"""Greedy packing of ordered rows into batches under a budget, without a task that reads a whole group."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillgraph.functions.session import cut, free_name
from quillgraph.operators.relational import running_sums

#: Rows of a block, and blocks of a group at most: a task holds one block, and the sums at all its group's block ends.
BLOCK_ROWS, MOST_BLOCKS = 1 << 16, 1 << 14


def _next_starts(index: np.ndarray, sums: np.ndarray, before: int, budget: int, header: int, batch_rows: int | None):
    """(place in the block of the next start, threshold, cap) of a batch that starts at each row.

    The next batch starts at the first row whose running sum exceeds the threshold, at the row of the
    cap, or, where a row overflows alone, at the row after it; places beyond the block are its length.
    """
    n = len(sums)
    threshold = np.concatenate([[before], sums[:-1]]) + (budget - header)
    # The row itself is always taken: a batch that it overflows alone ends where the sums rise again.
    nxt = np.maximum(np.searchsorted(sums, threshold, "right"), np.arange(1, n + 1))
    cap = index + (batch_rows if batch_rows is not None else np.int64(1) << 60)
    return np.minimum(nxt, cap - index[0]).clip(max=n), threshold, cap


def _last_starts(nxt: np.ndarray) -> np.ndarray:
    """The last start in the block of the chain from each row."""
    n = len(nxt)
    last = np.arange(n)
    # Next starts lie behind: from the end on, whoever has one in the block shares its last start.
    for i in range(n - 2, -1, -1):
        if nxt[i] < n:
            last[i] = last[nxt[i]]
    return last


def _entry(index: np.ndarray, sums: np.ndarray, threshold: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """Place in the block where the batch that follows starts, by the threshold and cap of the one before."""
    return np.minimum(np.searchsorted(sums, threshold, "right"), np.maximum(cap - index[0], 0))


def _arrays(block: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
    order = np.argsort(block.column("_i").to_numpy(), kind="stable")
    index, sums = block.column("_i").to_numpy()[order], block.column("_s").to_numpy()[order]
    return index, sums, int(sums[0] - block.column("_c").to_numpy()[order[0]])


def pack_in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence, cost: str, budget: int, header: int = 0, batch_rows: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``batch``, as ``context.pack_batches`` gives it, for groups of any size.

    Running sums place every row. A group's rows are dealt to blocks; in each block every row knows the
    start that follows, by a search in the sums, and so the last start of its chain in the block. Those
    last starts point to the last start of the chain in a later block. Doubling the pointers marks the
    ones reached from the group's first row, log2(blocks) joins in all, and each block then marks its
    own starts from the one that enters it.
    """
    g, c, one = (free_name(n, df.columns) for n in ("g", "c", "one"))
    group = F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("")
    rows = df.withColumn(g, group).withColumn(c, F.coalesce(F.col(cost).cast("long"), F.lit(0))).withColumn(one, F.lit(1).cast("long"))
    summed = cut(running_sums(running_sums(rows, [g], list(order), one, "_i"), [g], ["_i"], c, "_s"))
    most = summed.agg(F.coalesce(F.max("_i"), F.lit(0))).first()[0]
    per = max(block_rows, -(-most // MOST_BLOCKS))
    narrow = summed.select(F.col(g).alias("_g"), F.floor((F.col("_i") - 1) / per).cast("long").alias("_b"), "_i", "_s", F.col(c).alias("_c"))
    narrow = cut(narrow)
    ends = cut(narrow.groupBy("_g", "_b").agg(F.max("_s").alias("e")).groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_b", "e"))).alias("ends")))
    first = narrow.where("_i = 1").select("_g", "_b", F.lit(None).cast("long").alias("q"), F.lit(None).cast("long").alias("t"), F.lit(1).cast("long").alias("cap"))

    def exits(key, block: pa.Table, known: pa.Table) -> pa.Table:
        """The rows whose next start lies in a later block, with that block."""
        index, sums, before = _arrays(block)
        nxt, threshold, cap = _next_starts(index, sums, before, budget, header, batch_rows)
        q = np.flatnonzero(nxt == len(sums))
        bounds = np.array([e["e"] for e in known.column("ends")[0].as_py()], np.int64)
        by_sum = np.searchsorted(bounds, threshold[q], "right")
        to = np.minimum(np.maximum(by_sum, key[1].as_py() + 1), (cap[q] - 1) // per)
        # A cap beyond the group's last row, in its last block, leads nowhere.
        on = (to < len(bounds)) & (to > key[1].as_py())
        return pa.table({"_g": pa.array([key[0].as_py()] * int(on.sum()), pa.string()), "_b": to[on].astype(np.int64), "q": index[q][on], "t": threshold[q][on], "cap": cap[q][on]})

    def entered(key, block: pa.Table, entries: pa.Table):
        index, sums, before = _arrays(block)
        nxt, _, _ = _next_starts(index, sums, before, budget, header, batch_rows)
        t, cap = entries.column("t").fill_null(np.iinfo(np.int64).max).to_numpy(), entries.column("cap").to_numpy()
        return index, nxt, _entry(index, sums, t, cap)

    def edges(key, block: pa.Table, entries: pa.Table) -> pa.Table:
        if not block.num_rows or not entries.num_rows:
            return pa.table({"_g": pa.array([], pa.string()), "q": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        index, nxt, place = entered(key, block, entries)
        on = place < len(index)
        q = entries.filter(pa.array(on))
        return pa.table({"_g": q.column("_rg"), "q": q.column("q"), "to": index[_last_starts(nxt)[place[on]]]})

    def marks(key, block: pa.Table, entries: pa.Table) -> pa.Table:
        index = np.sort(block.column("_i").to_numpy())
        start = np.zeros(len(index), np.int64)
        if entries.num_rows:
            index, nxt, place = entered(key, block, entries)
            at = int(place.min())
            while at < len(index):
                start[at] = 1
                at = int(nxt[at])
        return pa.table({"_g": pa.array([key[0].as_py()] * len(index), pa.string()), "_b": pa.array([key[1].as_py()] * len(index), pa.int64()), "_i": index, "n": np.cumsum(start)})

    # The block's sums at all ends come with each block: MOST_BLOCKS numbers at most.
    def together(right: DataFrame, f, schema: str) -> DataFrame:
        right = right.withColumnsRenamed({"_g": "_rg", "_b": "_rb"})
        return narrow.groupBy("_g", "_b").cogroup(right.groupBy("_rg", "_rb")).applyInArrow(f, schema)

    blocks = narrow.select("_g", "_b").distinct().join(ends, "_g")
    leaving = cut(together(blocks, exits, "_g string, _b long, q long, t long, cap long"))
    step = cut(together(leaving.unionByName(first), edges, "_g string, q long, to long"))
    reached = cut(step.where("q is null").select("_g", F.col("to").alias("q")))
    jump = cut(step.where("q is not null"))
    while not jump.isEmpty():
        met = reached.join(jump, ["_g", "q"]).select("_g", F.col("to").alias("q"))
        grown = cut(reached.unionByName(met).distinct(), in_loop=True)
        if grown.count() == reached.count():
            break
        reached = grown
        far = jump.select("_g", F.col("q").alias("to"), F.col("to").alias("far"))
        jump = cut(jump.join(far, ["_g", "to"]).select("_g", "q", F.col("far").alias("to")), in_loop=True)
    taken = leaving.join(reached, ["_g", "q"], "left_semi").unionByName(first)
    marked = cut(together(taken, marks, "_g string, _b long, _i long, n long"))
    earlier = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = marked.groupBy("_g", "_b").agg(F.max("n").alias("m")).withColumn("base", F.coalesce(F.sum("m").over(earlier), F.lit(0))).drop("m")
    batch = marked.join(base, ["_g", "_b"]).select(F.col("_g").alias("_kg"), F.col("_i").alias("_ki"), (F.col("base") + F.col("n") - 1).alias("batch"))
    return summed.join(batch, (F.col(g) == F.col("_kg")) & (F.col("_i") == F.col("_ki"))).select(*[f"`{x}`" for x in df.columns], "batch")


def pack_in_stream(df: DataFrame, keys: Sequence[str], order: Sequence, cost: str, budget: int, header: int = 0, batch_rows: int | None = None) -> DataFrame:
    """The same for groups of few rows: each is read by one task as a sorted stream, and never held."""
    at = [df.columns.index(c) for c in (*keys, cost)]
    dealt = (df.repartition(*keys) if keys else df.repartition(1)).sortWithinPartitions(*keys, *order)

    def run(stream):
        group, batch, used, n = None, 0, header, 0
        for rows in stream:
            *names, costs = (rows.column(i).to_pylist() for i in at)
            names = list(zip(*names, strict=True)) if names else [()] * rows.num_rows
            out = []
            for name, c in zip(names, costs, strict=True):
                c = c or 0
                if name != group:
                    group, batch, used, n = name, 0, header, 0
                elif n and (used + c > budget or batch_rows is not None and n >= batch_rows):
                    batch, used, n = batch + 1, header, 0
                used, n = used + c, n + 1
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(out, pa.int64())], names=[*rows.schema.names, "batch"])

    return dealt.mapInArrow(run, StructType([*df.schema.fields, StructField("batch", LongType())]))
