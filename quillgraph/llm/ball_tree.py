"""Exact inner-product search: a ball tree in every shard, searched by branch and bound."""

from __future__ import annotations

import io
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.functions.session import as_uri, cut, remove, shared_dir

#: Queries that a shard's tree is searched with at a time; blocks lie in the shared folder.
QUERY_BLOCK = 4096
#: Rows that give every query its first bound on the k-th score.
SEED_ROWS = 2048
LEAF_ROWS = 256
SHARD_ROWS = 65_536
#: Bounds of other shards that a shard takes in before it searches a block, newest first.
GOSSIP = 8


class BallTree:
    """Nodes hold a centre and a radius; an inner product in a node is at most q·c + r|q|."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.ids, self.vectors, self.leaf = ids, vectors, leaf
        self.nodes: list[tuple] = []
        self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        x = self.vectors[rows]
        centre = x.mean(0)
        radius = float(np.sqrt(((x - centre) ** 2).sum(1).max()))
        me = len(self.nodes)
        self.nodes.append(None)
        if len(rows) <= self.leaf:
            kids = ()
        else:
            far = x[((x - centre) ** 2).sum(1).argmax()]
            other = x[((x - far) ** 2).sum(1).argmax()]
            along = x @ (far - other)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2
            kids = (self._build(rows[order[:half]]), self._build(rows[order[half:]]))
        self.nodes[me] = (centre, radius, kids, None if kids else rows)
        return me

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best ids and scores of every query (score descending, id ascending); -1 pads.

        ``kth`` holds a lower bound of each query's k-th score and rises as the search goes on; a
        node is left out for the queries whose bound lies above all it can hold.
        """
        n = len(queries)
        norms = np.sqrt((queries**2).sum(1))
        top_s = np.full((n, k), -np.inf)
        top_i = np.full((n, k), np.iinfo(np.int64).max)
        # Slack for rounding: a bound is never below the true maximum.
        slack = 1e-9 * (norms * (1 + np.abs(self.vectors).max(initial=0) * self.vectors.shape[1])) + 1e-6

        def bound(node: int, active: np.ndarray) -> np.ndarray:
            centre, radius, _, _ = self.nodes[node]
            return queries[active] @ centre + radius * norms[active] + slack[active]

        stack = [(0, np.arange(n), None)]
        while stack:
            node, active, upper = stack.pop()
            upper = bound(node, active) if upper is None else upper
            active = active[upper >= kth[active]]
            if not len(active):
                continue
            _, _, kids, rows = self.nodes[node]
            if kids:
                both = [(float((b := bound(kid, active)).mean()), kid, b) for kid in kids]
                for _, kid, b in sorted(both, key=lambda x: x[0]):  # the most promising is popped first
                    stack.append((kid, active, b))
                continue
            scores = queries[active] @ self.vectors[rows].T
            ids = self.ids[rows]
            scores[own[active][:, None] == ids[None, :]] = -np.inf
            s = np.concatenate([top_s[active], scores], 1)
            i = np.concatenate([top_i[active], np.broadcast_to(ids, scores.shape)], 1)
            order = np.lexsort((i, -s), axis=1)[:, :k]
            top_s[active] = np.take_along_axis(s, order, 1)
            top_i[active] = np.take_along_axis(i, order, 1)
            kth[active] = np.maximum(kth[active], top_s[active][:, -1])
        return top_i, top_s


def _matrix(batch: pa.Table, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and integer vectors (held in float64, exact below 2^53)."""
    column = batch.column("v")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return ids, flat.reshape(len(ids), -1) if len(ids) else np.empty((0, dims or 0))


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v, dims): floor(scale * x) of each component; rows that cannot take part are left out.

    A row takes part if its id and vector are not null and every component is non-null and finite.
    """
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & whole).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v"), F.size(v).alias("dims")
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, seed_rows: int = SEED_ROWS) -> DataFrame:
    """Each query's k best rows by inner product: (query_id, rank, vec_id, score), materialised.

    ``vectors`` and ``queries`` are (id, v array<long>, dims). Queries are written to the shared folder
    in blocks of about ``query_block``, each with a first bound of its k-th score from ``seed_rows``
    rows; the driver holds none. Vectors are read once and never leave their shard: a shard builds its
    tree, goes through the blocks, and leaves the bounds it reaches in the shared folder for the
    others. A bound that comes late or not at all costs time only. A row is never an answer to its own
    id; equal scores go to the smaller id; fewer than k rows give fewer answers. Of rows of one id
    each is a candidate of its own; as a query an id has the least of its vectors. Vectors of
    different length never meet. Scores must stay below 2^53.
    """
    spark = vectors.sparkSession
    asked = queries.groupBy("id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    counts = {r["dims"]: r["n"] for r in asked.groupBy("dims").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    parts = {dims: -(-n // max(1, query_block * 3 // 4)) for dims, n in counts.items()}
    seeds = {dims: _matrix(vectors.where(F.col("dims") == dims).limit(seed_rows).select("id", "v").toArrow(), dims) for dims in parts}
    folder = as_uri(f"{shared_dir(spark)}/queries-{uuid.uuid4().hex}")

    def first(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dims in set(batch.column(2).to_pylist()):
                mine = table.filter(pa.array([d == dims for d in batch.column(2).to_pylist()]))
                ids, q = _matrix(mine, dims)
                yield from mine.append_column("first", pa.array(_first_bounds(ids, q, seeds[dims], k))).to_batches()

    part = F.pmod(F.xxhash64("id"), F.create_map(*[F.lit(x) for both in parts.items() for x in both])[F.col("dims")])
    blocks = asked.withColumn("part", part).mapInArrow(first, "id long, v array<long>, dims int, part long, first double")
    try:
        blocks.repartition("dims", "part").write.partitionBy("dims", "part").parquet(f"{folder}/blocks")
        found = vectors.select("id", "v", "dims").mapInArrow(_shard_search(folder, parts, k), "query_id long, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
        top = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
        return cut(top.select("query_id", "rank", "vec_id", "score"))
    finally:
        remove(spark, folder)


def _first_bounds(q_ids, q, seed: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """The k-th score among the seed rows that may answer; -inf where there are fewer."""
    ids, x = seed
    if len(ids) < k:
        return np.full(len(q_ids), -np.inf)
    scores = q @ x.T
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    return np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]


class _Blocks:
    """Query blocks in the shared folder, and the bounds that shards leave beside them."""

    def __init__(self, folder: str, me: str):
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.me, self.held, self.seen = me, {}, set()

    def read(self, dims: int, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        where = f"{self.root}/blocks/dims={dims}/part={part}"
        if where not in self.held:
            if len(self.held) >= 8:
                self.held.clear()
            if self.store.get_file_info(where).type == fs.FileType.NotFound:
                table = pa.table({"id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.int64())), "first": pa.array([], pa.float64())})
            else:
                table = pq.read_table(where, filesystem=self.store, columns=["id", "v", "first"], partitioning=None).sort_by("id")
            ids, q = _matrix(table, dims)
            self.held[where] = ids, q, table.column("first").to_numpy().copy()
        return self.held[where]

    def bounds(self, dims: int, part: int, kth: np.ndarray) -> None:
        """Raise ``kth`` to what other shards have reached."""
        where = f"{self.root}/bounds/{dims}-{part}"
        files = self.store.get_file_info(fs.FileSelector(where, allow_not_found=True))
        files = sorted((f.base_name for f in files if f.base_name.endswith(".npy") and f.path not in self.seen), reverse=True)
        for name in files[:GOSSIP]:
            self.seen.add(f"{where}/{name}")
            with self.store.open_input_stream(f"{where}/{name}") as f:
                other = np.load(io.BytesIO(f.read()))
            np.maximum(kth, other, out=kth)

    def leave(self, dims: int, part: int, kth: np.ndarray) -> None:
        where, raw = f"{self.root}/bounds/{dims}-{part}", io.BytesIO()
        np.save(raw, kth)
        self.store.create_dir(where, recursive=True)
        name = f"{time.time_ns():020d}-{self.me}"
        with self.store.open_output_stream(f"{where}/{name}.part", compression=None) as f:
            f.write(raw.getvalue())
        self.store.move(f"{where}/{name}.part", f"{where}/{name}.npy")  # whole or not at all


def _shard_search(folder: str, parts: dict[int, int], k: int):
    def run(batches):
        held, rows = [], 0
        blocks = _Blocks(folder, f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex[:8]}")

        def flush():
            table = pa.Table.from_batches(held)
            lengths = table.column("dims").to_numpy()
            for dims in np.unique(lengths).tolist():
                if dims not in parts:
                    continue
                ids, x = _matrix(table.filter(pa.array(lengths == dims)), dims)
                tree = BallTree(ids, x)
                for part in range(parts[dims]):
                    q_ids, q, kth = blocks.read(dims, part)  # kth rises in place, from tree to tree
                    if not len(q_ids):
                        continue
                    blocks.bounds(dims, part, kth)
                    got, scores = tree.search(q, q_ids, k, kth)
                    blocks.leave(dims, part, kth)
                    keep = (scores > -np.inf) & (scores >= kth[:, None])
                    which = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[which[0]]), pa.array(got[keep]), pa.array(scores[keep].astype(np.int64))], names=["query_id", "vec_id", "score"]
                    )

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= SHARD_ROWS:
                yield from flush()
                held, rows = [], 0
        if rows:
            yield from flush()

    return run


def op10_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ball-tree top 5 of every row whose id is divisible by 50, against all rows of ``embeddings``."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where(F.col("id") % 50 == 0), k=5)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
