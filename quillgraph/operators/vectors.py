"""Vector distances, nearest neighbours and vector aggregation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str) -> Column:
    """cosine, l1, l2, linf or inner (the negative inner product); a zero vector has no cosine distance."""
    diff = F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y))
    made = {
        "cosine": lambda: F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b)),
        "l1": lambda: F.aggregate(diff, F.lit(0.0), lambda s, x: s + x),
        "l2": lambda: F.sqrt(F.aggregate(diff, F.lit(0.0), lambda s, x: s + x * x)),
        "linf": lambda: F.array_max(diff),
        "inner": lambda: -dot(a, b),
    }
    if metric not in made:
        raise ValueError(f"unknown metric {metric!r}")
    return made[metric]()


def distances(store: DataFrame, queries: DataFrame, metric: str = "l2", id_col: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", max_queries: int = 1000) -> DataFrame:
    """(query_id, id, distance) of every query and row, where the row lies; nothing is shuffled.

    The stated queries, at most ``max_queries``, go with the plan. Rows without a vector take no part.
    """
    held = queries.select(F.col(query_id), F.col(query_vector)).where(F.col(query_vector).isNotNull()).limit(max_queries + 1).collect()
    if len(held) > max_queries:
        raise ValueError(f"more than {max_queries} queries: search them in blocks")
    base = store.where(F.col(vector).isNotNull())
    if not held:
        return base.select(F.lit(None).alias(query_id), id_col, F.lit(0.0).alias("distance")).limit(0)
    array = F.array(*[F.struct(F.lit(r[0]).alias("q"), F.array(*[F.lit(float(x)) for x in r[1]]).alias("v")) for r in held])
    pairs = base.select(F.col(id_col), F.col(vector), F.explode(array).alias("_q"))
    return pairs.select(F.col("_q.q").alias(query_id), id_col, distance(F.col(vector), F.col("_q.v"), metric).alias("distance"))


def knn(store: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "query_vector", max_queries: int = 1000) -> DataFrame:
    """(query_id, id, distance, score, nth): each query's k nearest rows, ties to the smaller id.

    The window's group limit keeps k rows a task and query before the shuffle. The score is
    1 - |distance|.
    """
    rows = distances(store, queries, metric, id_col, vector, query_id, query_vector, max_queries)
    best = Window.partitionBy(query_id).orderBy("distance", id_col)
    return rows.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).withColumn("score", F.lit(1.0) - F.abs("distance")).select(query_id, id_col, "distance", "score", "nth")


def within_threshold(found: DataFrame, threshold: float, similarity: bool = False) -> DataFrame:
    """Rows with a distance above the threshold (as first defined), or at most it with ``similarity``."""
    return found.where(F.col("distance") <= threshold if similarity else F.col("distance") > threshold)


def centroid(df: DataFrame, keys: list[str], vector: str, weight: str | None = None) -> DataFrame:
    """(keys, n, mean): element-wise (weighted) mean by position, pre-aggregated before the shuffle."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    long = df.where(F.col(vector).isNotNull()).select(*keys, w.alias("_w"), F.posexplode(_double(F.col(vector))).alias("_p", "_x"))
    per = long.groupBy(*keys, "_p").agg((F.sum(F.col("_x") * F.col("_w")) / F.sum("_w")).alias("_m"), F.count("*").alias("_n"))
    return per.groupBy(*keys).agg(F.max("_n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("_p", "_m"))), lambda x: x["_m"]).alias("mean"))


def unit(v: Column) -> Column:
    return F.transform(v, lambda x: F.try_divide(x, norm(v)))


def reconstitute(pieces: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, embedding): the only piece as it is, or the unit mean of several."""
    mean = centroid(pieces, [key], vector)
    return mean.select(key, F.when(F.col("n") == 1, F.col("mean")).otherwise(unit(F.col("mean"))).alias("embedding"))


def weighted_embedding(pieces: DataFrame, key: str, vector: str, length: str) -> DataFrame:
    """(key, embedding): unit mean of pieces weighted by their lengths."""
    return centroid(pieces, [key], vector, length).select(key, unit(F.col("mean")).alias("embedding"))


def nearest_to_centroid(df: DataFrame, id_col: str, vector: str, k: int) -> DataFrame:
    """(id, distance): the k rows nearest to the mean of all."""
    mean = centroid(df, [], vector).select("mean")
    rows = df.where(F.col(vector).isNotNull()).join(F.broadcast(mean))  # a single row
    return rows.select(id_col, distance(F.col(vector), F.col("mean"), "l2").alias("distance")).orderBy("distance", id_col).limit(k)


def knn_by_text(store: DataFrame, text: str, embed, k: int, metric: str = "l2", **columns) -> DataFrame:
    """The k rows nearest to a text, embedded as the store's were; an empty text has none."""
    q = store.sparkSession.createDataFrame([(0, text)], "query_id int, q string").where("trim(q) <> ''")
    return knn(store, q.select("query_id", embed(F.col("q")).alias("query_vector")), k, metric, **columns)


def map_query_entities(store: DataFrame, entities: DataFrame, query: DataFrame | None, k: int, include: list[str] = (), exclude: list[str] = (), oversample: int = 2) -> DataFrame:
    """(place, title, rank): entities of a query: named ones first, then the k * oversample nearest.

    ``store`` is (id, vector), ``entities`` (id, title, rank). Without a query vector the k of
    highest rank are taken. Excluded titles go; included ones come first in their order.
    """
    if query is None:
        best = entities.orderBy(F.desc(F.coalesce("rank", F.lit(0))), "title").limit(k).withColumn("_o", F.row_number().over(Window.orderBy(F.desc(F.coalesce("rank", F.lit(0))), "title")))
    else:
        near = knn(store, query, k * oversample).select(F.col("id").alias("_id"), F.col("nth").alias("_o"))
        best = entities.join(near, F.col("id") == F.col("_id"))
    found = best.where(~F.col("title").isin(list(exclude))).select(F.lit(1).alias("_g"), "_o", "title", "rank")
    if include:
        order = F.create_map(*[x for i, t in enumerate(include) for x in (F.lit(t), F.lit(i))])
        found = found.unionByName(entities.where(F.col("title").isin(list(include))).select(F.lit(0).alias("_g"), order[F.col("title")].alias("_o"), "title", "rank"))
    return found.select(F.row_number().over(Window.orderBy("_g", "_o", "title")).alias("place"), "title", "rank")
