"""Relational verbs: named DataFrame -> DataFrame steps that workflows are composed of."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.session import free_name


@dataclass
class VerbInput:
    """A verb's source table, its other tables in order, and tables by name."""

    source: DataFrame
    others: list[DataFrame] = field(default_factory=list)
    named: dict[str, DataFrame] = field(default_factory=dict)


Verb = Callable[..., DataFrame]
VERBS: dict[str, Verb] = {}


def verb(name: str) -> Callable[[Verb], Verb]:
    """Register a verb; a later registration of the same name replaces it."""

    def add(f: Verb) -> Verb:
        VERBS[name] = f
        return f

    return add


# -- columns ---------------------------------------------------------------------------------


@verb("select")
def select(t: VerbInput, columns: Sequence[str]) -> DataFrame:
    return t.source.select(*columns)


@verb("rename")
def rename(t: VerbInput, columns: dict[str, str]) -> DataFrame:
    return t.source.withColumnsRenamed(columns)


@verb("drop")
def drop(t: VerbInput, columns: Sequence[str]) -> DataFrame:
    return t.source.drop(*columns)


@verb("copy")
def copy(t: VerbInput, column: str, to: str) -> DataFrame:
    return t.source.withColumn(to, F.col(column))


@verb("fill")
def fill(t: VerbInput, to: str, value: Any) -> DataFrame:
    return t.source.withColumn(to, F.lit(value))


@verb("fill_null")
def fill_null(t: VerbInput, column: str, value: Any) -> DataFrame:
    return t.source.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


_OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "+": lambda a, b: a + b,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b,
    "/": lambda a, b: F.try_divide(a, b),
    "%": lambda a, b: F.try_mod(a, b),
    "concat": lambda a, b: F.concat(a.cast("string"), b.cast("string")),
}


@verb("derive")
def derive(t: VerbInput, to: str, column1: str, operator: str, column2: str) -> DataFrame:
    """``column1 operator column2``; division by zero is null."""
    if operator not in _OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    return t.source.withColumn(to, _OPERATORS[operator](F.col(column1), F.col(column2)))


@verb("convert")
def convert(t: VerbInput, columns: Sequence[str], type: str, delimiter: str = ",") -> DataFrame:
    """Cast that gives null where a value does not fit; ``array`` splits a string."""

    def one(c: str) -> Column:
        if type == "array":
            return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(F.col(c), _literal(delimiter)))
        return F.col(c).try_cast({"str": "string", "integer": "long", "float": "double"}.get(type, type))

    return t.source.withColumns({c: one(c) for c in columns})


def _literal(text: str) -> str:
    """A regular expression that matches ``text`` itself."""
    return "".join(f"\\{c}" if c in r"\.[]{}()*+-?^$|&#~" else c for c in text)


@verb("pack")
def pack(t: VerbInput, columns: Sequence[str], to: str) -> DataFrame:
    """Columns as one struct."""
    return t.source.withColumn(to, F.struct(*columns))


# -- rows ------------------------------------------------------------------------------------

_PREDICATES: dict[str, Callable[[Column, Any], Column]] = {
    "equals": lambda c, v: c == v,
    "not equals": lambda c, v: c != v,
    "is less than": lambda c, v: c < v,
    "is less than or equal": lambda c, v: c <= v,
    "is greater than": lambda c, v: c > v,
    "is greater than or equal": lambda c, v: c >= v,
    "contains": lambda c, v: c.contains(v),
    "starts with": lambda c, v: c.startswith(v),
    "ends with": lambda c, v: c.endswith(v),
    "in": lambda c, v: c.isin(list(v)),
}


def predicate(df: DataFrame, column: str, operator: str, value: Any = None) -> Column:
    """The condition of a filter criterion; a null row never fits a comparison."""
    c = F.col(column)
    if operator in ("is empty", "is not empty"):
        kind = dict(df.dtypes)[column]
        blank = F.size(c) == 0 if kind.startswith(("array", "map")) else c == "" if kind == "string" else F.isnan(c) if kind in ("double", "float") else F.lit(False)
        empty = c.isNull() | blank
        return empty if operator == "is empty" else ~empty
    if operator not in _PREDICATES:
        raise ValueError(f"unknown predicate {operator!r}")
    return _PREDICATES[operator](c, value)


@verb("filter")
def filter_rows(t: VerbInput, column: str, criteria: Sequence[dict[str, Any]]) -> DataFrame:
    """Rows that fit any criterion {type: value|column, operator, value}."""
    conditions = [predicate(t.source, column, c["operator"], F.col(c["value"]) if c.get("type") == "column" else c.get("value")) for c in criteria]
    return t.source.where(reduce(lambda a, b: a | b, conditions))


@verb("dedupe")
def dedupe(t: VerbInput, columns: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """One row per key: the first in ``order`` (by default of all other columns), so reruns agree."""
    df = t.source
    if not columns:
        return df.distinct()
    order = order or [c for c in df.columns if c not in columns] or list(columns)
    best = Window.partitionBy(*columns).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(best)).where("_nth = 1").drop("_nth")


@verb("orderby")
def orderby(t: VerbInput, orders: Sequence[dict[str, str]]) -> DataFrame:
    return t.source.orderBy(*[F.desc(o["column"]) if o.get("direction", "asc").startswith("d") else F.asc(o["column"]) for o in orders])


@verb("sample")
def sample(t: VerbInput, size: int, key: str, seed: int = 0) -> DataFrame:
    """``size`` rows by the order of md5(seed, key): a seeded sample that reruns repeat."""
    return t.source.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(size)


@verb("unroll")
def unroll(t: VerbInput, column: str, to: str | None = None) -> DataFrame:
    """One row per list element; an empty or null list keeps its row with null."""
    rest = [c for c in t.source.columns if c != column]
    return t.source.select(*rest, F.explode_outer(column).alias(to or column))


# -- joins -----------------------------------------------------------------------------------


def suffixed(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes=("_1", "_2")) -> tuple[DataFrame, DataFrame]:
    """Both sides with colliding non-key columns renamed."""
    both = (set(left.columns) & set(right.columns)) - set(keys)
    return left.withColumnsRenamed({c: c + suffixes[0] for c in both}), right.withColumnsRenamed({c: c + suffixes[1] for c in both})


@verb("join")
def join(t: VerbInput, on: Sequence[str], strategy: str = "inner", null_safe: bool = True) -> DataFrame:
    """Equi join of the source with the first other table on [left] or [left, right].

    Null keys meet null keys unless ``null_safe`` is off. A shared key column appears once.
    """
    left_key, right_key = on[0], on[-1]
    how = {"inner": "inner", "left": "left", "left outer": "left", "right": "right", "right outer": "right", "outer": "full", "full": "full", "semi": "left_semi", "anti": "left_anti"}[strategy]
    shared = [left_key] if left_key == right_key else []
    left, right = t.source, t.others[0]
    if how not in ("left_semi", "left_anti"):
        left, right = suffixed(left, right, shared)
        left_key = left_key if left_key in left.columns else left_key + "_1"
        right_key = right_key if right_key in right.columns else right_key + "_2"
    right = right.withColumnRenamed(right_key, "_right_key")
    a, b = F.col(left_key), F.col("_right_key")
    out = left.join(right, a.eqNullSafe(b) if null_safe else a == b, how)
    if how in ("left_semi", "left_anti"):
        return out
    if shared:
        return out.withColumn(left_key, F.coalesce(left_key, "_right_key")).drop("_right_key")
    return out.withColumnRenamed("_right_key", right_key)


def anti_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    return join(VerbInput(left, [right]), [on], "anti")


def semi_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """Rows of ``left`` whose key occurs in ``right``; the key table is reduced before the join."""
    keys = right.select(F.col(right_key).alias("_key")).distinct()
    return left.join(keys, F.col(left_key) == F.col("_key"), "left_semi")


# -- sets ------------------------------------------------------------------------------------


@verb("concat")
def concat(t: VerbInput, column_wise: bool = False, order: Sequence[str] | None = None) -> DataFrame:
    """Rows of all tables by column name, missing columns null; or columns side by side.

    Side by side, rows pair by their place in ``order`` (each table's own columns by default).
    """
    if not column_wise:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), t.others, t.source)
    tables = []
    for k, df in enumerate([t.source, *t.others]):
        by = [c for c in (order or df.columns) if c in df.columns] or df.columns
        tables.append(df.withColumnsRenamed({c: f"{c}_{k}" for c in df.columns if k and any(c in x.columns for x in [t.source, *t.others][:k])}).withColumn("_place", F.row_number().over(Window.orderBy(*[f"{c}_{k}" if k and any(c in x.columns for x in [t.source, *t.others][:k]) else c for c in by]))))
    return reduce(lambda a, b: a.join(b, "_place", "full"), tables).orderBy("_place").drop("_place")


@verb("union")
def union(t: VerbInput) -> DataFrame:
    return concat(t).distinct()


@verb("intersect")
def intersect(t: VerbInput) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b.select(a.columns)), t.others, t.source)


@verb("difference")
def difference(t: VerbInput) -> DataFrame:
    return reduce(lambda a, b: a.exceptAll(b.select(a.columns)).distinct(), t.others, t.source)


# -- aggregation -----------------------------------------------------------------------------


def aggregation(operation: str, column: str, separator: str = ",") -> Column:
    """Column of an aggregation by name; lists and strings are sorted, so reruns agree."""
    c = F.col(column)
    found = {
        "array_agg": lambda: F.array_sort(F.collect_list(c)),
        "array_agg_distinct": lambda: F.array_sort(F.collect_set(c)),
        "any": lambda: F.min(c),
        "string_concat": lambda: F.array_join(F.array_sort(F.collect_list(c.cast("string"))), separator),
        "sum": lambda: F.sum(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "mean": lambda: F.avg(c),
        "median": lambda: F.median(c),
        "count": lambda: F.count(F.lit(1)),
        "distinct": lambda: F.count_distinct(c),
        "valid": lambda: F.count(c),
        "invalid": lambda: F.count_if(c.isNull()),
        "mode": lambda: F.mode(c, True),
        "product": lambda: F.product(c),
        "stdev": lambda: F.stddev_samp(c),
        "stdevp": lambda: F.stddev_pop(c),
        "variance": lambda: F.var_samp(c),
    }
    if operation not in found:
        raise ValueError(f"unknown aggregation {operation!r}")
    return found[operation]()


@verb("aggregate_override")
def aggregate(t: VerbInput, aggregations: Sequence[dict[str, Any]], groupby: Sequence[str] | None = None) -> DataFrame:
    """Aggregations {column, operation, to, separator}; rows with a null key form no group."""
    made = [aggregation(a["operation"], a["column"], a.get("separator", ",")).alias(a["to"]) for a in aggregations]
    if not groupby:
        return t.source.agg(*made)
    keys = [groupby] if isinstance(groupby, str) else list(groupby)
    return t.source.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])).groupBy(*keys).agg(*made)


@verb("aggregate")
def aggregate_one(t: VerbInput, column: str, operation: str, to: str, groupby: str | None = None) -> DataFrame:
    return aggregate(t, [{"column": column, "operation": operation, "to": to}], [groupby] if groupby else None)


# -- order and identity ----------------------------------------------------------------------


@verb("window")
def window(t: VerbInput, operation: str, to: str, column: str | None = None, order: Sequence[str] | None = None, partition: Sequence[str] | None = None) -> DataFrame:
    """Window functions by name; an ``uuid`` is md5 of the row's order columns and its place among equal ones."""
    df = t.source
    order = list(order or ([column] if column else df.columns))
    w = Window.partitionBy(*(partition or [])).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {
        "uuid": lambda: F.md5(F.concat_ws("#", F.to_json(F.struct(*order)), (F.row_number().over(Window.partitionBy(*order).orderBy(*order)) - 1).cast("string"))),
        "row_number": lambda: F.row_number().over(w),
        "rank": lambda: F.rank().over(w),
        "percent_rank": lambda: F.percent_rank().over(w),
        "cume_dist": lambda: F.cume_dist().over(w),
        "first_value": lambda: F.first(column).over(whole),
        "last_value": lambda: F.last(column).over(whole),
        "fill_down": lambda: F.last(column, ignorenulls=True).over(before),
        "fill_up": lambda: F.first(column, ignorenulls=True).over(after),
    }
    if operation not in made:
        raise ValueError(f"unknown window operation {operation!r}")
    return df.withColumn(to, made[operation]())


@verb("genid")
def genid(t: VerbInput, to: str, method: str = "md5_hash", hash: Sequence[str] | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """Ids by md5 of the text of columns joined without a separator, or by place in ``order`` from 1."""
    if method == "md5_hash":
        if not hash:
            raise ValueError("md5_hash needs columns to hash")
        return t.source.withColumn(to, F.md5(F.concat_ws("", *[F.col(c).cast("string") for c in hash])))
    if method == "increment":
        return t.source.withColumn(to, F.row_number().over(Window.orderBy(*(order or t.source.columns))))
    raise ValueError(f"unknown id method {method!r}")


def enumerate_rows(df: DataFrame, to: str, order: Sequence[str]) -> DataFrame:
    """0-based place in ``order``: ranges are sorted apart and offset by the counts before them."""
    sorted_ = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()).sortWithinPartitions(*order)
    from quillgraph.functions.session import cut

    fixed = cut(sorted_)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    heads = fixed.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(F.col("_part").alias("_p"), "_base")
    inside = Window.partitionBy("_part").orderBy(*order)
    return fixed.join(F.broadcast(heads), F.col("_part") == F.col("_p")).withColumn(to, (F.row_number().over(inside) - 1 + F.col("_base")).cast("long")).drop("_part", "_p", "_base")


def running_sums(df: DataFrame, keys: Sequence[str], order: Sequence, value: str, to: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of its group up to each row, in ``order``.

    Ranges of (keys, order) are sorted and summed apart. A range may begin inside a group, and only in
    its first one: what that group has in the ranges before is added, so a group may lie in many
    ranges and none is held by one task. Rows equal in ``keys`` and ``order`` come in any order.
    """
    from quillgraph.functions.session import cut

    by = [F.col(k).asc_nulls_first() for k in keys] + [F.col(c) if isinstance(c, str) else c for c in order]
    part, own = free_name("part", df.columns), free_name("own", df.columns)
    names = [free_name(f"k{i}", df.columns) for i in range(len(keys))]
    fixed = cut(df.repartitionByRange(*by).withColumn(part, F.spark_partition_id()))
    # A row for each range and group: groups that lie in several ranges are few ranges' ends.
    totals = fixed.groupBy(part, *keys).agg(F.sum(value).alias("s"))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    heads = totals.withColumn("base", F.sum("s").over(before)).where("base is not null")
    heads = heads.select(F.col(part).alias("p_"), "base", *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    inside = Window.partitionBy(part, *keys).orderBy(*by[len(keys) :]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    same = F.col(part) == F.col("p_")
    for k, n in zip(keys, names, strict=True):
        same &= F.col(k).eqNullSafe(F.col(n))
    # One group at most continues into each range, so there are no more heads than ranges.
    met = fixed.withColumn(own, F.sum(value).over(inside)).join(F.broadcast(heads), same, "left")
    return met.withColumn(to, F.col(own) + F.coalesce("base", F.lit(0))).select(*df.columns, to)


# -- reshaping verbs ---------------------------------------------------------------------------


@verb("merge")
def merge(t: VerbInput, columns: Sequence[str], to: str, strategy: str = "concat", delimiter: str = "") -> DataFrame:
    """Several columns as one: joined text (nulls skipped), array, struct text, or the first or last non-null."""
    cols = [F.col(c) for c in columns]
    made = {
        "concat": lambda: F.concat_ws(delimiter, *[c.cast("string") for c in cols]),
        "array": lambda: F.array(*cols),
        "json": lambda: F.to_json(F.struct(*cols)),
        "first one wins": lambda: F.coalesce(*cols),
        "last one wins": lambda: F.coalesce(*reversed(cols)),
    }
    return t.source.withColumn(to, made[strategy]())


@verb("zip")
def zip_columns(t: VerbInput, columns: Sequence[str], to: str, type: str | None = None) -> DataFrame:
    """Columns as a struct; or, as ``dict``, a key array and a value array as a map (the last key wins)."""
    if type == "dict":
        if len(columns) != 2:
            raise ValueError("a dict needs a key column and a value column")
        keys, values = F.col(columns[0]), F.col(columns[1])
        same = F.when(F.size(keys) != F.size(values), F.raise_error(F.lit("keys and values differ in number")).cast("boolean")).otherwise(F.lit(True))
        last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p["k"]))
        return t.source.withColumn(to, F.when(same, F.map_from_entries(last)))
    return t.source.withColumn(to, F.struct(*columns))


@verb("unzip")
def unzip(t: VerbInput, column: str, to: Sequence[str]) -> DataFrame:
    """Fields of a struct, or elements of an array, as columns by position."""
    kind = t.source.schema[column].dataType
    if kind.typeName() == "struct":
        return t.source.withColumns({name: F.col(column)[kind.fieldNames()[i]] for i, name in enumerate(to)})
    return t.source.withColumns({name: F.get(column, F.lit(i)) for i, name in enumerate(to)})


@verb("spread_json")
def spread_json(t: VerbInput, column: str, schema: str, copy: Sequence[str] = ()) -> DataFrame:
    """Fields of a JSON object as columns; null or broken JSON gives nulls; only ``copy`` columns stay."""
    return t.source.select(*copy, F.from_json(F.coalesce(F.col(column), F.lit("{}")), schema).alias("_j")).select(*copy, "_j.*")


@verb("pivot")
def pivot(t: VerbInput, key: str, value: str, operation: str, values: Sequence[Any], groupby: Sequence[str]) -> DataFrame:
    return t.source.groupBy(*groupby).pivot(key, list(values)).agg(aggregation(operation, value))


@verb("fold")
def fold(t: VerbInput, columns: Sequence[str], to: Sequence[str] = ("key", "value")) -> DataFrame:
    rest = [c for c in t.source.columns if c not in columns]
    return t.source.unpivot(rest, list(columns), to[0], to[1])


@verb("spread")
def spread(t: VerbInput, column: str, to: Sequence[str], delimiter: str = ",") -> DataFrame:
    parts = F.split(F.col(column), _literal(delimiter))
    return t.source.withColumns({name: F.get(parts, F.lit(i)) for i, name in enumerate(to)})


@verb("onehot")
def onehot(t: VerbInput, column: str, values: Sequence[Any], prefix: str = "") -> DataFrame:
    return t.source.withColumns({f"{prefix}{v}": F.when(F.col(column).eqNullSafe(F.lit(v)), 1).otherwise(0) for v in values})


@verb("binarize")
def binarize(t: VerbInput, column: str, to: str, operator: str, value: Any) -> DataFrame:
    return t.source.withColumn(to, F.when(predicate(t.source, column, operator, value), 1).otherwise(0))


@verb("bin")
def bin_values(t: VerbInput, column: str, to: str, step: float, low: float = 0.0) -> DataFrame:
    """Lower border of the fixed-width bin of a value."""
    return t.source.withColumn(to, F.lit(low) + F.floor((F.col(column) - low) / step) * step)


@verb("recode")
def recode(t: VerbInput, column: str, to: str, mapping: dict[Any, Any]) -> DataFrame:
    out = F.col(column)
    for old, new in mapping.items():
        out = F.when(F.col(column) == F.lit(old), F.lit(new)).otherwise(out)
    return t.source.withColumn(to, out)


@verb("impute")
def impute(t: VerbInput, column: str, value: Any) -> DataFrame:
    return fill_null(t, column, value)


@verb("erase")
def erase(t: VerbInput, column: str, values: Sequence[Any]) -> DataFrame:
    return t.source.withColumn(column, F.when(~F.col(column).isin(list(values)), F.col(column)))


@verb("normalize")
def normalize(t: VerbInput, column: str, to: str) -> DataFrame:
    """Min-max scaling; a constant column gives null."""
    ends = t.source.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    return t.source.join(F.broadcast(ends)).withColumn(to, F.try_divide(F.col(column) - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_lo", "_hi")


@verb("lookup")
def lookup(t: VerbInput, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Columns of the other table's first row of each key (least by those columns)."""
    key = on[-1]
    right = t.others[0].groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*columns)).alias("_row")).select("_key", "_row.*")
    return t.source.join(right, F.col(on[0]) == F.col("_key"), "left").drop("_key")


@verb("rollup")
def rollup(t: VerbInput, column: str, operation: str, to: str) -> DataFrame:
    return aggregate(t, [{"column": column, "operation": operation, "to": to}])


@verb("boolean")
def boolean(t: VerbInput, columns: Sequence[str], to: str, operator: str = "and") -> DataFrame:
    made = reduce((lambda a, b: a & b) if operator == "and" else (lambda a, b: a | b), [F.col(c).cast("boolean") for c in columns])
    return t.source.withColumn(to, made)


@verb("strings")
def strings(t: VerbInput, column: str, to: str, operation: str) -> DataFrame:
    return t.source.withColumn(to, {"lower": F.lower, "upper": F.upper, "trim": F.trim, "length": F.length, "reverse": F.reverse}[operation](F.col(column)))


@verb("unorder")
def unorder(t: VerbInput) -> DataFrame:
    return t.source


@verb("ungroup")
def ungroup(t: VerbInput) -> DataFrame:
    return t.source


@verb("destructure")
def destructure(t: VerbInput, column: str) -> DataFrame:
    return t.source.select(*[c for c in t.source.columns if c != column], f"{column}.*")
