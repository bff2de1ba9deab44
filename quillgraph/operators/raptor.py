"""Trees of clustered summaries: splitting, clustering, construction, retrieval."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.functions.session import cut
from quillgraph.operators.context import within_budget
from quillgraph.operators.relational import enumerate_rows
from quillgraph.operators.vectors import distances, knn

def split_texts(df: DataFrame, id_col: str, text: str, max_tokens: int = 100) -> DataFrame:
    """(id, nth, chunk, n_tokens): sentences packed in order into chunks of ``max_tokens`` at most.

    A sentence above the limit is cut at commas, colons and semicolons, and its parts share no chunk
    with other sentences; a part above the limit is a chunk. Empty sentences and parts vanish.
    """
    bare = lambda c: F.regexp_replace(c, r"^[ \t\r\n\f]+|[ \t\r\n\f]+$", "")
    cut_at = lambda c, marks: F.filter(F.transform(F.split(c, marks), bare), lambda x: x != "")
    piece = lambda i, apart, t: F.struct(i.alias("i"), F.lit(apart).alias("apart"), t.alias("t"), T.num_tokens(t).alias("n"))

    def pieces(sentence: Column, i: Column) -> Column:
        parts = F.transform(cut_at(sentence, "[,;:]"), lambda t: piece(i, True, t))
        return F.when(T.num_tokens(sentence) > max_tokens, parts).otherwise(F.array(piece(i, False, sentence)))

    state = "struct<done:array<string>,held:string,i:int,apart:boolean,n:bigint>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("held"), F.lit(-1).alias("i"), F.lit(False).alias("apart"), F.lit(0).cast("long").alias("n")).cast(state)

    def add(acc: Column, x: Column) -> Column:
        fresh = acc["held"].isNull() | ((acc["apart"] | x["apart"]) & (acc["i"] != x["i"])) | (acc["n"] + x["n"] > max_tokens)
        done = F.when(fresh & acc["held"].isNotNull(), F.array_append(acc["done"], acc["held"])).otherwise(acc["done"])
        held = F.when(fresh, x["t"]).otherwise(F.concat_ws(" ", acc["held"], x["t"]))
        return F.struct(done.alias("done"), held.alias("held"), x["i"].alias("i"), x["apart"].alias("apart"), F.when(fresh, x["n"]).otherwise(acc["n"] + x["n"]).alias("n")).cast(state)

    ends = lambda acc: F.when(acc["held"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["held"]))
    parts = df.select(id_col, F.flatten(F.transform(cut_at(F.coalesce(F.col(text), F.lit("")), "[.!?\n]"), pieces)).alias("_p"))
    chunks = parts.select(id_col, F.posexplode(F.aggregate("_p", start, add, ends)).alias("nth", "chunk"))
    return chunks.select(id_col, F.col("nth").cast("long").alias("nth"), "chunk", T.num_tokens(F.col("chunk")).alias("n_tokens"))


def reduce_dimensions(df: DataFrame, id_col: str, vector: str, dimensions: int) -> DataFrame:
    """(id, reduced): principal components of unit vectors."""
    from pyspark.ml.feature import PCA, Normalizer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = df.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    v = Normalizer(inputCol="_v", outputCol="_u").transform(v)
    return PCA(k=dimensions, inputCol="_u", outputCol="_p").fit(v).transform(v).select(id_col, vector_to_array("_p").alias("reduced"))


# Fixed values of the mixtures: sweeps at most, change of log likelihood that ends them, least variance (of one).
SWEEPS, SETTLED, LEAST_VARIANCE = 20, 0.01, 1e-6
#: Rows, for each cluster of the largest mixture, among which all mixtures start.
DRAWN = 20
#: Rows whose densities a task holds at a time.
BLOCK = 1000


def soft_clusters(df: DataFrame, id_col: str, vector: str, threshold: float = 0.1, max_clusters: int = 5, seed: int = 224) -> DataFrame:
    """(id, cluster, probability): a Gaussian mixture of the number of clusters (from 1) of least BIC.

    A row is in every cluster whose probability exceeds the threshold, so in none or several. The
    mixtures of all numbers are fitted at once: a sweep reads every row once, tasks add up each
    component's statistics, and only their sums reach the driver. Mixtures that settled drop out.
    """
    import numpy as np
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    x = cut(df.where(F.col(vector).isNotNull()).select(id_col, F.col(vector).cast("array<double>").alias("x")))
    n = x.count()
    if not n:
        return x.select(id_col, F.lit(0).alias("cluster"), F.lit(1.0).alias("probability"))
    # Small tables come in few files; a sweep's work is spread nevertheless.
    x = cut(x.repartition(min(2 * x.sparkSession.sparkContext.defaultParallelism, n // BLOCK + 1), id_col))
    moments = x.select(array_to_vector("x").alias("v")).agg(Summarizer.metrics("mean", "std").summary(F.col("v")).alias("m")).first()["m"]
    mean, scale = moments["mean"].toArray(), moments["std"].toArray()
    scale = np.where(scale > 0, scale, 1.0)
    d, most = len(mean), max(1, min(max_clusters, n - 1))
    drawn = x.orderBy(F.xxhash64(id_col, F.lit(seed)), id_col, "x").limit(DRAWN * most).select("x").collect()
    drawn = (np.array([r["x"] for r in drawn]) - mean) / scale
    models = {k: _start(drawn, k, seed) for k in range(1, most + 1)}
    loglik, active = {}, sorted(models)
    for sweep in range(SWEEPS + 1):
        weights, owner = np.hstack([models[k] for k in active]), np.repeat(active, active)
        sums = x.mapInArrow(_sweep(weights, owner, mean, scale), "component int, sums array<double>")
        sums = sums.groupBy("component").agg(Summarizer.sum(array_to_vector("sums")).alias("s")).select("component", vector_to_array("s").alias("s")).collect()
        sums = np.array([r["s"] for r in sorted(sums)])
        going = []
        for k in active:
            mine = np.flatnonzero(owner == k)
            now, settled = sums[mine, -1].sum(), False
            if k in loglik:
                settled = abs(now - loglik[k]) <= SETTLED
            loglik[k] = now
            if not settled and sweep < SWEEPS:
                models[k] = _maximise(sums[mine, :-1], models[k], n, d)
                going.append(k)
        active = going
        if not active:
            break
    free = lambda k: k * (d + d * (d + 1) / 2) + k - 1
    best = min(loglik, key=lambda k: (-2 * loglik[k] + free(k) * math.log(n), k))
    if best == 1:
        return x.select(id_col, F.lit(0).alias("cluster"), F.lit(1.0).alias("probability"))
    p = x.mapInArrow(_shares(models[best], mean, scale, id_col), f"`{id_col}` {dict(x.dtypes)[id_col]}, p array<double>")
    return p.select(id_col, F.posexplode("p").alias("cluster", "probability")).where(F.col("probability") > threshold)


def _features(x):
    """One, the components, and the products of every two: a Gaussian's log density is linear in them."""
    import numpy as np

    i, j = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, i] * x[:, j]])


def _gaussian(weight: float, mean, cov):
    """Coefficients of log(weight * density) over the features; no variance is below the least."""
    import numpy as np

    values, axes = np.linalg.eigh(cov)
    values = np.maximum(values, LEAST_VARIANCE)
    inverse = (axes / values) @ axes.T
    const = math.log(max(weight, 1e-300)) - 0.5 * (len(mean) * math.log(2 * math.pi) + np.log(values).sum() + mean @ inverse @ mean)
    i, j = np.triu_indices(len(mean))
    return np.concatenate([[const], inverse @ mean, np.where(i == j, -0.5, -1.0) * inverse[i, j]])


def _start(drawn, k: int, seed: int):
    """(features, k): components around k drawn rows, far apart, moved to the means of the rows nearest to them."""
    import numpy as np

    r = np.random.default_rng([seed, k])
    centres = drawn[[r.integers(len(drawn))]]
    while len(centres) < k:
        far = ((drawn[:, None] - centres) ** 2).sum(2).min(1)
        centres = np.vstack([centres, drawn[r.choice(len(drawn), p=far / far.sum() if far.sum() > 0 else None)]])
    for _ in range(10):
        of = ((drawn[:, None] - centres) ** 2).sum(2).argmin(1)
        centres = np.stack([drawn[of == c].mean(0) if (of == c).any() else centres[c] for c in range(k)])
    spread = np.maximum(((drawn - centres[of]) ** 2).mean(0), 1e-3)
    return np.stack([_gaussian(max((of == c).mean(), 0.1 / k), m, np.diag(spread)) for c, m in enumerate(centres)], 1)


def _maximise(sums, old, n: int, d: int):
    """(features, k): the mixture of summed features; a component that no row is in stays where it is."""
    import numpy as np

    out, (i, j) = old.copy(), np.triu_indices(d)
    for c, s in enumerate(sums):
        if s[0] < 1e-9:
            out[0, c] = -1e300
            continue
        mean, cov = s[1 : d + 1] / s[0], np.zeros((d, d))
        cov[i, j] = cov[j, i] = s[d + 1 :] / s[0] - mean[i] * mean[j]
        out[:, c] = _gaussian(s[0] / n, mean, cov)
    return out


def _blocks(batch, mean, scale):
    """Standardised rows of an Arrow batch, block by block."""
    import numpy as np

    x = batch.column(batch.num_columns - 1)
    x = (x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(mean)) - mean) / scale
    for at in range(0, len(x), BLOCK):
        yield np.ascontiguousarray(x[at : at + BLOCK])


def _sweep(weights, owner, mean, scale):
    """A task's sums: for every component its features by share, and its mixture's log likelihood in its first one."""
    import numpy as np
    import pyarrow as pa

    begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    count = np.diff(np.r_[begin, len(owner)])

    def run(batches):
        sums, loglik = np.zeros((len(owner), len(weights))), np.zeros(len(begin))
        for batch in batches:
            for x in _blocks(batch, mean, scale):
                f = _features(x)
                log = f @ weights
                top = np.maximum.reduceat(log, begin, axis=1)
                share = np.exp(log - np.repeat(top, count, axis=1))
                whole = np.add.reduceat(share, begin, axis=1)
                share /= np.repeat(whole, count, axis=1)
                sums += share.T @ f
                loglik += (top + np.log(whole)).sum(0) - len(x) * np.log(scale).sum()
        last = np.zeros(len(owner))
        last[begin] = loglik
        yield pa.RecordBatch.from_pydict({"component": pa.array(np.arange(len(owner)), pa.int32()), "sums": pa.array(list(np.c_[sums, last]), pa.list_(pa.float64()))})

    return run


def _shares(weights, mean, scale, id_col: str):
    """Every row's probabilities of the components."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            logs = [_features(x) @ weights for x in _blocks(batch, mean, scale)]
            if logs:
                log = np.concatenate(logs)
                share = np.exp(log - log.max(1, keepdims=True))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(share / share.sum(1, keepdims=True)), pa.list_(pa.float64()))], names=[id_col, "p"])

    return run


def cluster_nodes(df: DataFrame, id_col: str, vector: str, dimensions: int = 5, threshold: float = 0.1, max_clusters: int = 50) -> DataFrame:
    """(id, cluster): soft clusters in a reduced space, ``max_clusters`` at most."""
    n = df.count()
    if n <= dimensions + 1:
        return df.select(id_col, F.lit(0).alias("cluster"))
    reduced = cut(reduce_dimensions(df, id_col, vector, dimensions))
    return soft_clusters(reduced, id_col, "reduced", threshold, max_clusters).select(id_col, "cluster")


def two_stage_clusters(df: DataFrame, id_col: str, vector: str, dimensions: int = 5, threshold: float = 0.1, max_clusters: int = 50) -> DataFrame:
    """(id, cluster): soft clusters over all rows, each clustered again by itself; numbered through.

    A global cluster of too few rows to cluster is one cluster. Rows are matched by id, so rows of
    equal vectors stay apart. The driver goes through the global clusters, ``max_clusters`` at most.
    """
    rows = cut(df.select(id_col, vector))
    whole = cut(cluster_nodes(rows, id_col, vector, dimensions, threshold, max_clusters).withColumnRenamed(id_col, "_id"))
    out, offset = None, 0
    for (number,) in whole.select("cluster").distinct().orderBy("cluster").collect():
        mine = rows.join(whole.where(F.col("cluster") == number).select("_id"), F.col(id_col) == F.col("_id"), "left_semi")
        local = cut(cluster_nodes(mine, id_col, vector, dimensions, threshold, max_clusters))
        out = (lambda x: x if out is None else out.unionByName(x))(local.select(id_col, (F.col("cluster") + offset).alias("cluster")))
        offset += (local.agg(F.max("cluster")).first()[0] or 0) + 1
    return cut(out) if out is not None else whole.select(F.col("_id").alias(id_col), "cluster")


def bounded_clusters(df: DataFrame, id_col: str, vector: str, text: str, max_tokens: int = 3500, depth: int = 8, **how) -> DataFrame:
    """(id, cluster): two-stage clusters; one whose texts exceed ``max_tokens`` is clustered again.

    A cluster of one row, or that does not fall apart, stays as it is, and so does what ``depth``
    rounds leave. Token sums are added up before the shuffle; the driver sees long clusters only.
    """
    rows = cut(df.select(id_col, vector, T.num_tokens(F.col(text)).alias("_n")))
    found, done, offset = cut(two_stage_clusters(rows, id_col, vector, **how)), None, 0
    for _ in range(depth):
        sums = found.withColumnRenamed(id_col, "_id").join(rows, F.col("_id") == F.col(id_col)).groupBy("cluster").agg(F.sum("_n").alias("tokens"), F.count("*").alias("rows"))
        long = [r["cluster"] for r in sums.where((F.col("tokens") > max_tokens) & (F.col("rows") > 1)).orderBy("cluster").collect()]
        fine = found.where(~F.col("cluster").isin(long)) if long else found
        parts = []
        for number in long:
            members = found.where(F.col("cluster") == number).select(F.col(id_col).alias("_id"))
            again = cut(two_stage_clusters(rows.join(members, F.col(id_col) == F.col("_id"), "left_semi"), id_col, vector, **how))
            if again.select("cluster").distinct().count() < 2:
                fine = fine.unionByName(found.where(F.col("cluster") == number))
            else:
                parts.append(again)
        done = fine.select(id_col, F.concat_ws("/", F.lit(str(offset)), F.col("cluster").cast("string")).alias("c")) if done is None else done.unionByName(fine.select(id_col, F.concat_ws("/", F.lit(str(offset)), F.col("cluster").cast("string")).alias("c")))
        offset += 1
        found = None
        base = 0
        for part in parts:
            part = part.select(id_col, (F.col("cluster") + base).alias("cluster"))
            base = part.agg(F.max("cluster")).first()[0] + 1
            found = part if found is None else found.unionByName(part)
        if found is None:
            break
        found = cut(found)
    if found is not None:
        done = done.unionByName(found.select(id_col, F.concat_ws("/", F.lit(str(offset)), F.col("cluster").cast("string")).alias("c")))
    names = done.select("c").distinct().select(F.col("c").alias("_c"), (F.row_number().over(Window.orderBy("c")) - 1).alias("cluster"))
    return done.join(names, F.col("c") == F.col("_c")).select(id_col, "cluster")


def build_tree(leaves: DataFrame, embed: Callable[[Column], Column], summarize: Callable[[Column], Column], layers: int = 3, dimensions: int = 5, max_clusters: int = 50, max_tokens: int = 3500) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a tree over leaves (idx long, text): (idx, layer, text, embedding), (parent, child).

    Every layer's nodes are clustered, each cluster's texts summarised and embedded as a node of the
    next; the tree ends where a layer has too few nodes to cluster. Layers are checkpointed.
    """
    level = cut(leaves.select(F.col("idx").cast("long").alias("idx"), F.lit(0).alias("layer"), "text", embed(F.col("text")).alias("embedding")))
    nodes, edges = level, None
    for layer in range(1, layers + 1):
        size = level.agg(F.count("*").alias("n"), F.max("idx").alias("m")).first()
        if size["n"] <= dimensions + 1:
            break
        members = cut(bounded_clusters(level, "idx", "embedding", "text", max_tokens, dimensions=dimensions, max_clusters=max_clusters).withColumnRenamed("idx", "child"))
        joined = level.join(members, F.col("idx") == F.col("child"))
        texts = joined.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n\n").alias("_t"))
        parents = texts.withColumn("idx", F.lit(size["m"] + 1) + F.col("cluster"))
        # Written before it is embedded: a model is asked once, and what is stored is what is embedded.
        told = cut(parents.select(F.col("idx").cast("long").alias("idx"), F.lit(layer).alias("layer"), summarize(F.col("_t")).alias("text")))
        level = cut(told.withColumn("embedding", embed(F.col("text"))))
        up = members.select((F.lit(size["m"] + 1) + F.col("cluster")).cast("long").alias("parent"), "child")
        nodes, edges = nodes.unionByName(level), up if edges is None else edges.unionByName(up)
    if edges is None:
        edges = leaves.sparkSession.createDataFrame([], "parent long, child long")
    return cut(nodes), cut(edges)


def collapsed_retrieval(nodes: DataFrame, query: DataFrame, top_k: int, max_tokens: int, metric: str = "cosine") -> DataFrame:
    """(nth, idx, distance, n_tokens): nearest nodes of any layer, within a token budget, in order."""
    near = knn(nodes.select("idx", "embedding"), query, top_k, metric, "idx", "embedding").select(F.col("idx").alias("_i"), "distance", "nth")
    rows = nodes.join(near, F.col("idx") == F.col("_i")).withColumn("n_tokens", T.num_tokens(F.col("text")))
    return within_budget(rows, "n_tokens", max_tokens, ["nth"]).select("nth", "idx", "distance", "n_tokens")


def tree_descent(nodes: DataFrame, edges: DataFrame, query: DataFrame, start_layer: int, layers: int, top_k: int, metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(layer, idx, distance): the chosen nodes of each layer, children of the layer above's choice."""
    current, out = nodes.where(F.col("layer") == start_layer), None
    for layer in range(start_layer, max(start_layer - layers, -1), -1):
        if threshold is None:
            near = knn(current.select("idx", "embedding"), query, top_k, metric, "idx", "embedding")
        else:
            near = distances(current.select("idx", "embedding"), query, metric, "idx", "embedding").where(F.col("distance") > threshold)
        chosen = cut(near.select(F.lit(layer).alias("layer"), "idx", "distance"))
        out = chosen if out is None else out.unionByName(chosen)
        below = edges.join(chosen.select(F.col("idx").alias("_p")), F.col("parent") == F.col("_p")).select(F.col("child").alias("_c")).distinct()
        current = nodes.join(below, F.col("idx") == F.col("_c"), "left_semi")
    return out


def flat_retrieval(chunks: DataFrame, query: DataFrame, top_k: int, max_tokens: int | None = None) -> DataFrame:
    """(nth, idx, score): best inner products; with a budget, up to and with the chunk that overflows it."""
    near = knn(chunks.select("idx", "embedding"), query, top_k, "inner", "idx", "embedding").select(F.col("idx").alias("_i"), (-F.col("distance")).alias("score"), "nth")
    rows = chunks.join(near, F.col("idx") == F.col("_i")).withColumn("n_tokens", T.num_tokens(F.col("text")))
    if max_tokens is not None:
        rows = within_budget(rows, "n_tokens", max_tokens, ["nth"], include_overflow=True)
    return rows.select("nth", "idx", "score")


class TextTree:
    """Facade: add documents, retrieve, answer, save and load (Parquet)."""

    def __init__(self, embed: Callable[[Column], Column], summarize: Callable[[Column], Column], answer: Callable[[str, str], str]):
        self.embed, self.summarize, self.answer = embed, summarize, answer
        self.nodes = self.edges = None

    def add_documents(self, docs: DataFrame, id_col: str, text: str, max_tokens: int = 100, **how) -> None:
        chunks = split_texts(docs, id_col, text, max_tokens)
        leaves = enumerate_rows(chunks, "idx", [id_col, "nth"]).select("idx", F.col("chunk").alias("text"))
        self.nodes, self.edges = build_tree(leaves, self.embed, self.summarize, **how)

    def retrieve(self, question: str, top_k: int = 10, max_tokens: int = 3500, collapse: bool = True) -> DataFrame:
        if top_k < 1 or max_tokens < 1:
            raise ValueError("top_k and max_tokens must be positive")
        q = self.nodes.sparkSession.createDataFrame([(0, question)], "query_id int, q string").select("query_id", self.embed(F.col("q")).alias("query_vector"))
        if collapse:
            return collapsed_retrieval(self.nodes, q, top_k, max_tokens)
        top = self.nodes.agg(F.max("layer")).first()[0]
        return tree_descent(self.nodes, self.edges, q, top, top + 1, top_k)

    def answer_question(self, question: str, **how) -> str:
        found = self.retrieve(question, **how).select(F.col("idx").alias("_i"))
        rows = self.nodes.join(found, F.col("idx") == F.col("_i")).orderBy("idx").select(F.array_join(F.split("text", "\n"), " ").alias("t")).collect()
        return self.answer("\n\n".join(r["t"] for r in rows), question)

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").parquet(f"{path}/edges")

    def load(self, spark, path: str) -> None:
        self.nodes, self.edges = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def layer_of_nodes(layers: DataFrame) -> DataFrame:
    """(node, layer) of rows (layer, nodes array); a node of several layers has the last."""
    return layers.select("layer", F.explode("nodes").alias("node")).groupBy("node").agg(F.max("layer").alias("layer"))


def layer_texts(nodes: DataFrame, layer: int) -> DataFrame:
    """(idx, text) of a layer, line ends as spaces."""
    return nodes.where(F.col("layer") == layer).select("idx", F.array_join(F.split("text", "\n"), " ").alias("text"))
