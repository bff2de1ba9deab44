"""Inverted-file index of vectors: a coarse quantiser, lists as partition folders, residual codes, exact re-ranking."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.session import cut, narrow_batches
from quillgraph.operators.vectors import distance

#: Lists at most, and bytes of centroids that may go with a plan.
MOST_LISTS = 4096
CENTROID_BYTES = 128 << 20
#: Rows of the sample that teaches the centroids, for each list.
SAMPLE_PER_LIST = 64
#: Rows of a list that one file holds; a larger list is dealt over several.
FILE_ROWS = 500_000
#: Bytes of the queries that go with one plan, and pairs of a query and a list that the driver weighs at a time;
#: more queries are searched in blocks.
QUERY_BYTES = 16 << 20
QUERY_LISTS = 1 << 22
#: Distances that a task holds at a time.
HELD = 1 << 20


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of all rows of x and y, to within 1e-6 of their lengths."""
    square = (x * x).sum(1)[:, None] - 2 * (x @ y.T) + (y * y).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def usable(df: DataFrame, id_col: str = "id", vector: str = "vector") -> DataFrame:
    """(id, vector array<double>) of the rows that take part: no null, empty or non-finite vector."""
    v = F.col(vector).cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~odd).select(F.col(id_col).alias("id"), v.alias("vector"))


def build(df: DataFrame, folder: str, lists: int | None = None, seed: int = 7, iterations: int = 8, sample_per_list: int = SAMPLE_PER_LIST) -> None:
    """Index every usable row of (id, vector) under ``folder``; an index that lies there is replaced.

    ``lists`` is the square root of the rows unless given, MOST_LISTS at most. The centroids are
    learned from about ``sample_per_list`` rows for each list, picked by a hash of their vectors. A
    row lies in the folder of its nearest centroid with its vector, one byte for each component of
    the residual, and the length of what the bytes miss. All vectors must have the width of the widest.
    """
    rows = usable(df)
    known = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width"), F.min(F.size("vector")).alias("least")).first()
    n, width = known["n"], known["width"]
    if not n:
        _empty(rows).write.mode("overwrite").parquet(f"{folder}/rows")  # no folders, but a file with the columns
        rows.select(F.lit(0).alias("list"), "vector", F.lit(0.0).alias("radius"), F.lit(0).cast("long").alias("n")).limit(0).write.mode("overwrite").parquet(f"{folder}/lists")
        return
    if width != known["least"]:
        raise ValueError(f"vectors of {known['least']} to {width} components in one index")
    lists = min(lists or int(np.ceil(np.sqrt(n))), MOST_LISTS, n)
    if lists * width * 8 > CENTROID_BYTES:
        raise ValueError(f"{lists} centroids of {width} components are more than a plan may carry: ask for fewer lists")
    centres = _centres(rows, n, lists, sample_per_list, seed, iterations)
    coded = cut(_coded(rows, centres))
    sizes = cut(coded.groupBy("list").agg(F.max("away").alias("radius"), F.count("*").alias("n")))
    # Files of a list: no task writes more than FILE_ROWS of a hot one.
    part = F.pmod(F.xxhash64("id", "vector"), F.ceil(F.col("n") / FILE_ROWS))
    placed = coded.join(F.broadcast(sizes.select(F.col("list").alias("k"), "n")), F.col("list") == F.col("k"))  # MOST_LISTS rows
    placed.repartition("list", part).select("id", "vector", "code", "low", "step", "err", "list").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/rows")
    held = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "k int, vector array<double>")
    held.join(sizes, F.col("k") == F.col("list")).select("list", "vector", "radius", "n").coalesce(1).write.mode("overwrite").parquet(f"{folder}/lists")


def _empty(rows: DataFrame) -> DataFrame:
    zero = F.lit(0.0)
    return rows.select("id", "vector", F.lit(b"").alias("code"), zero.alias("low"), zero.alias("step"), zero.alias("err"), F.lit(0).alias("list")).limit(0)


def _centres(rows: DataFrame, n: int, lists: int, sample_per_list: int, seed: int, iterations: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    share = min(1.0, lists * sample_per_list / n)
    picked = F.pmod(F.xxhash64("vector", F.lit(seed)), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))
    sample = cut(rows.where(picked).select(array_to_vector("vector").alias("features")))
    if sample.isEmpty():  # equal vectors have one hash
        sample = cut(rows.select(array_to_vector("vector").alias("features")).limit(lists))
    if lists == 1:
        from pyspark.ml.functions import vector_to_array

        return np.array([sample.select(vector_to_array("features")).first()[0]])
    return np.array(KMeans(k=lists, initMode="random", maxIter=iterations, seed=seed).fit(sample).clusterCenters())


def _coded(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """(list, away, low, step, err, code) beside id and vector; away is the distance to the centroid."""
    kind = dict(rows.dtypes)["id"]
    width = centres.shape[1]

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1), width)
            near = _distances(x, centres).argmin(1)
            rest = x - centres[near]
            low = rest.min(1)
            step = (rest.max(1) - low) / 255
            code = np.rint((rest - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.uint8)
            missed = rest - (low[:, None] + step[:, None] * code)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(np.linalg.norm(rest, axis=1)), pa.array(low), pa.array(step), pa.array(np.linalg.norm(missed, axis=1)), pa.array([r.tobytes() for r in code], pa.binary())],
                names=["id", "vector", "list", "away", "low", "step", "err", "code"],
            )

    narrow_batches(rows.sparkSession)
    return rows.mapInArrow(run, f"id {kind}, vector array<double>, list int, away double, low double, step double, err double, code binary")


class IvfIndex:
    """An index written by ``build``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        held = spark.read.parquet(f"{folder}/lists").orderBy("list").collect()
        self.names = np.array([r["list"] for r in held], np.int64)
        self.centres = np.array([r["vector"] for r in held], np.float64)
        self.radius = np.array([r["radius"] for r in held], np.float64)
        self._rows = spark.read.parquet(f"{folder}/rows")  # the folders are listed once

    def rows(self) -> DataFrame:
        return self._rows

    def block(self) -> int:
        """Queries that one search takes."""
        return max(1, min(QUERY_BYTES // (8 * max(1, self.centres.shape[-1])), QUERY_LISTS // max(1, len(self.names))))

    def probed(self, names) -> DataFrame:
        """The stored rows of the lists named; the scan opens their folders only."""
        if len(names) == len(self.names):
            return self.rows()
        return self.rows().where(F.col("list").isin([int(x) for x in names]))

    def search(self, queries: list[tuple[Any, list[float]]], k: int, probes: int = 8, exact: bool = False, only: DataFrame | None = None) -> DataFrame:
        """(qno, id, distance, nth): each query's k nearest rows of those in its ``probes`` nearest lists.

        ``queries`` are as many as ``block`` says at most. Codes give each row a least and a greatest distance; every
        row whose least is within the k-th greatest is measured by its vector, however many they are.
        With ``exact`` further lists are opened: all that may hold a row nearer than the k-th, of which
        only rows come back that may be nearer. ``only`` (id) keeps its rows.
        """
        if len(queries) > self.block():
            raise ValueError(f"more than {self.block()} queries: search them in blocks")
        if not len(self.names) or not queries:
            return self.rows().select(F.lit(0).alias("qno"), "id", F.lit(0.0).alias("distance"), F.lit(0).alias("nth")).limit(0)
        q = np.array([v for _, v in queries], np.float64)
        if q.shape[1] != self.centres.shape[1]:
            raise ValueError(f"queries of {q.shape[1]} components in an index of {self.centres.shape[1]}")
        away = _distances(q, self.centres)
        wanted = np.zeros(away.shape, bool)
        np.put_along_axis(wanted, np.argsort(away, 1, kind="stable")[:, :probes], True, 1)
        found = cut(self._bounds(q, wanted, k, only))
        limit = self._limits(found, k)
        if exact:
            most = np.full(len(q), np.inf)
            for r in limit.collect():  # a row for each query of the block
                most[r["lq"]] = r["most"]
            slack = 1e-6 * (np.linalg.norm(q, axis=1)[:, None] + np.linalg.norm(self.centres, axis=1)[None, :] + self.radius)
            more = ~wanted & (away - self.radius - slack <= most[:, None])
            if more.any():
                found = cut(found.unionByName(self._bounds(q, more, k, only, most)))
                limit = self._limits(found, k)
                wanted |= more
        near = found.join(F.broadcast(limit), F.col("qno") == F.col("lq")).where("least <= most").select("qno", F.col("id").alias("cid"), F.col("list").alias("cl")).distinct()
        asked = self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "aq int, query array<double>")
        rows = self.probed(self.names[wanted.any(0)]).select("id", "list", "vector").join(cut(near), F.col("id").eqNullSafe(F.col("cid")) & (F.col("list") == F.col("cl")))
        rows = rows.join(F.broadcast(asked), F.col("qno") == F.col("aq")).select("qno", "id", distance(F.col("vector"), F.col("query"), "l2").alias("distance"))
        best = Window.partitionBy("qno").orderBy("distance", "id")
        return rows.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)

    def _limits(self, found: DataFrame, k: int) -> DataFrame:
        """(lq, most): the k-th greatest distance of each query, infinite where fewer rows are known."""
        nth = F.row_number().over(Window.partitionBy("qno").orderBy("greatest"))
        first = found.withColumn("nth", nth).where(F.col("nth") <= k).groupBy(F.col("qno").alias("lq"))
        return first.agg(F.when(F.count("*") == k, F.max("greatest")).otherwise(float("inf")).alias("most"))

    def _bounds(self, q: np.ndarray, wanted: np.ndarray, k: int, only: DataFrame | None, most: np.ndarray | None = None) -> DataFrame:
        """(qno, id, list, least, greatest) of the rows of wanted (query, list) pairs that their batch, and ``most``, leave open."""
        used = np.flatnonzero(wanted.any(0))
        # A bit for each pair goes with the plan.
        centre = {int(self.names[i]): (self.centres[i], np.packbits(wanted[:, i])) for i in used}
        rows = self.probed(centre).select("id", "list", "code", "low", "step", "err")
        if only is not None:
            rows = rows.join(only.select(F.col("id").alias("kept")).distinct(), F.col("id") == F.col("kept"), "left_semi")
        kind, width = dict(rows.dtypes)["id"], q.shape[1]
        length = np.linalg.norm(q, axis=1)
        names = ["qno", "id", "list", "least", "greatest"]

        def run(batches):
            for b in batches:
                lists = b.column(1).to_numpy()
                low, step, err = (b.column(i).to_numpy() for i in (3, 4, 5))
                for name in np.unique(lists).tolist():
                    at = np.flatnonzero(lists == name)
                    middle, bits = centre[name]
                    code = np.frombuffer(b"".join(b.column(2).take(pa.array(at)).to_pylist()), np.uint8).reshape(-1, width)
                    y = middle + low[at][:, None] + step[at][:, None] * code
                    everyone = np.flatnonzero(np.unpackbits(bits, count=len(q))).astype(np.int32)
                    some = max(1, HELD // len(at))
                    for asked in (everyone[s : s + some] for s in range(0, len(everyone), some)):
                        d = _distances(q[asked], y)
                        miss = err[at][None, :] + 1e-6 * (length[asked][:, None] + np.linalg.norm(y, axis=1)[None, :])
                        least, greatest = np.maximum(d - miss, 0), d + miss
                        kth = np.partition(greatest, k - 1, 1)[:, k - 1] if len(at) >= k else np.full(len(asked), np.inf)
                        if most is not None:
                            kth = np.minimum(kth, most[asked])
                        i, j = np.nonzero(least <= kth[:, None])
                        for s in range(0, len(i), 50_000):
                            x, r = i[s : s + 50_000], j[s : s + 50_000]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(asked[x]), b.column(0).take(pa.array(at[r])), pa.array(np.full(len(x), name, np.int32)), pa.array(least[x, r]), pa.array(greatest[x, r])], names=names
                            )

        narrow_batches(self.spark)
        return rows.mapInArrow(run, f"qno int, id {kind}, list int, least double, greatest double")


def search(index: IvfIndex, queries: DataFrame, k: int, folder: str, probes: int = 8, exact: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(query_id, id, distance, score, nth) of (query_id, query_vector), in blocks written under ``folder``.

    Queries without a usable vector have no rows; the score is 1 - |distance|, ties go to the smaller id.
    """
    spark = queries.sparkSession
    asked = usable(queries, "query_id", "query_vector")
    kind = dict(asked.dtypes)["id"]
    shape = f"query_id {kind}, id {dict(index.rows().dtypes)['id']}, distance double, score double, nth int"
    spark.createDataFrame([], shape).write.mode("overwrite").parquet(folder)
    block: list[tuple[Any, list[float]]] = []

    def flush():
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"n int, query_id {kind}")
        found = index.search(block, k, probes, exact, only).join(F.broadcast(names), F.col("qno") == F.col("n"))
        found.select("query_id", "id", "distance", (1 - F.abs("distance")).alias("score"), "nth").write.mode("append").parquet(folder)
        block.clear()

    for row in asked.toLocalIterator():
        block.append((row["id"], row["vector"]))
        if len(block) == index.block():
            flush()
    if block:
        flush()
    return spark.read.schema(shape).parquet(folder)
