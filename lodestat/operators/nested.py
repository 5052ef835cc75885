"""Comparison of nested records: every difference with its path, from the schema, or from JSON without one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from lodestat.storage import materialize

KIND = "array<struct<path:string,what:string,left:string,right:string>>"


def _none() -> Column:
    return F.array().cast(KIND)


def differences(left: Column, right: Column, a: DataType, b: DataType, path: str | Column = "$", volatile: Iterable[str] = ()) -> Column:
    """Array of (path, what, left, right), from the top down, fields in the order of their names; empty if both sides are equal.

    what: keys (fields or map keys of one side alone), length (of arrays), type, null (one side is null) or value. Under a node that
    differs in keys, length or type nothing further is compared. Fields and map keys in volatile are left out at any depth.
    """
    path = F.lit(path) if isinstance(path, str) else path
    volatile = sorted(volatile)

    def say(what: str, x: Column, y: Column) -> Column:
        return F.array(F.struct(path.alias("path"), F.lit(what).alias("what"), x.cast("string").alias("left"), y.cast("string").alias("right"))).cast(KIND)

    def below(x: Column, y: Column, s: DataType, t: DataType, name: Column) -> Column:
        return differences(x, y, s, t, F.concat(path, name), volatile)

    simple = False
    if isinstance(a, StructType) and isinstance(b, StructType):
        own, other = ({f.name: f.dataType for f in x.fields if f.name not in volatile} for x in (a, b))
        if set(own) != set(other):
            inner = say("keys", *(F.lit(",".join(sorted(set(x) - set(y)))) for x, y in ((own, other), (other, own))))
        elif own:
            inner = F.concat(*(below(left[n], right[n], own[n], other[n], F.lit(f".{n}")) for n in sorted(own)))
        else:
            inner = _none()
    elif isinstance(a, ArrayType) and isinstance(b, ArrayType):
        each = F.transform(left, lambda x, i: below(x, F.get(right, i), a.elementType, b.elementType, F.concat(F.lit("["), i.cast("string"), F.lit("]"))))
        inner = F.when(F.size(left) != F.size(right), say("length", F.size(left), F.size(right))).otherwise(F.flatten(each))
    elif isinstance(a, MapType) and isinstance(b, MapType) and a.keyType == b.keyType:
        keys = lambda m: F.array_sort(F.filter(F.map_keys(m), lambda k: ~k.cast("string").isin(volatile) if volatile else F.lit(True)))
        each = F.transform(keys(left), lambda k: below(F.try_element_at(left, k), F.try_element_at(right, k), a.valueType, b.valueType, F.concat(F.lit("."), k.cast("string"))))
        only = lambda x, y: F.array_join(F.array_except(keys(x), keys(y)), ",")
        inner = F.when(keys(left) != keys(right), say("keys", only(left, right), only(right, left))).otherwise(F.flatten(each))
    elif a.typeName() != b.typeName():
        inner, simple = F.when(left.isNull() & right.isNull(), _none()).otherwise(say("type", F.lit(a.simpleString()), F.lit(b.simpleString()))), True
    else:
        inner, simple = F.when(left.eqNullSafe(right), _none()).otherwise(say("value", left, right)), True
    if simple:
        return inner
    said = lambda x: F.when(x.isNotNull(), F.to_json(x))
    return F.when(left.isNull() & right.isNull(), _none()).when(left.isNull() | right.isNull(), say("null", said(left), said(right))).otherwise(inner)


def record_diff(a: DataFrame, b: DataFrame, key: str, volatile: Iterable[str] = ()) -> DataFrame:
    """key, state (left_only, right_only, repeated, equal or differs) and all differences of both sides' rows, joined by key; a null key
    matches a null one. Columns of one side alone are differences of keys at $. A key that a side has more than once is only reported."""

    def side(df: DataFrame, name: str) -> DataFrame:
        row = F.struct(*(c for c in df.columns if c != key))
        return df.groupBy(key).agg(F.any_value(row).alias(name), F.count(F.lit(1)).alias(f"n_{name}")).withColumnRenamed(key, f"k_{name}")

    x, y = side(a, "x"), side(b, "y")
    both = x.join(y, F.col("k_x").eqNullSafe(F.col("k_y")), "full_outer")
    found = differences(F.col("x"), F.col("y"), x.schema["x"].dataType, y.schema["y"].dataType, "$", volatile)
    pair = F.col("n_x").isNotNull() & F.col("n_y").isNotNull()
    out = both.select(F.coalesce("k_x", "k_y").alias(key), "n_x", "n_y", F.when(pair, found).otherwise(_none()).alias("differences"))
    state = F.when((F.col("n_x") > 1) | (F.col("n_y") > 1), "repeated").when(F.col("n_y").isNull(), "left_only").when(F.col("n_x").isNull(), "right_only")
    state = state.when(F.size("differences") > 0, "differs").otherwise("equal").alias("state")
    return out.select(key, state, F.when((F.col("n_x") > 1) | (F.col("n_y") > 1), _none()).otherwise(F.col("differences")).alias("differences"))


def first_paths(diff: DataFrame, key: str) -> DataFrame:
    """key and the first difference (path, what, left, right) of the rows of record_diff that differ."""
    return diff.where("state = 'differs'").select(key, F.get("differences", F.lit(0)).alias("d")).select(key, "d.*")


def mismatch_matrix(diff: DataFrame, key: str) -> DataFrame:
    """path (array places as []), what, n differences and n_rows that have some, of a record_diff."""
    each = diff.select(F.col(key).alias("row"), F.explode("differences").alias("d"))
    path = F.regexp_replace("d.path", r"\[[0-9]+\]", "[]")
    once = each.groupBy(path.alias("path"), F.col("d.what").alias("what"), "row").agg(F.count(F.lit(1)).alias("m"))
    return once.groupBy("path", "what").agg(F.sum("m").alias("n"), F.count(F.lit(1)).alias("n_rows"))


# JSON without a schema


def json_diff(a: DataFrame, b: DataFrame, key: str, column: str, volatile: Iterable[str] = ()) -> DataFrame:
    """key and the first difference (path, what, left, right) of the JSON of rows with that key on both sides; keys are unique.

    Nodes are compared by kind and by their sorted keys (objects), length (arrays) or text (anything else); what is no JSON is of kind
    INVALID. Both sides go down together, one pass a level of nesting, each written: nodes with the same text are left, and below a node
    that differs there is no earlier difference. Volatile keys are left out at any depth.
    """
    volatile, found = sorted(volatile), []
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # parsing is much work for few bytes, by which partitions would be joined
    x, y = (df.select(key, F.col(column).alias(n)).repartition(parts, key) for df, n in ((a, "x"), (b, "y")))
    level = x.join(y, key).select(key, F.array().cast("array<string>").alias("at"), F.lit("$").alias("path"), "x", "y")
    hidden = F.array(*map(F.lit, volatile)).cast("array<string>")

    def judged(df: DataFrame) -> DataFrame:
        df = df.where(~F.col("x").eqNullSafe(F.col("y"))).withColumns({f"v{c}": F.try_parse_json(c) for c in "xy"}).withColumns({f"t{c}": F.to_json(f"v{c}") for c in "xy"})
        begins = lambda c: F.substring(f"t{c}", 1, 1)
        shape = lambda c: F.regexp_extract(F.schema_of_variant(f"v{c}"), "^[A-Z]+", 0)
        kind = lambda c: F.when(F.col(f"v{c}").isNull(), "INVALID").when(begins(c) == "{", "OBJECT").when(begins(c) == "[", "ARRAY").otherwise(shape(c))
        df = df.withColumns({f"k{c}": kind(c) for c in "xy"})
        keys = lambda c: F.array_join(F.sort_array(F.array_except(F.json_object_keys(c), hidden)), ",")
        value = lambda c: F.when(F.col(f"k{c}") == "OBJECT", keys(c)).when(F.col(f"k{c}") == "ARRAY", F.json_array_length(c).cast("string")).otherwise(F.col(c))
        return df.select(key, "at", "path", *(F.struct(F.col(f"k{c}").alias("kind"), value(c).alias("value")).alias(f"n{c}") for c in "xy"), *(F.when(F.col(f"k{c}").isin("OBJECT", "ARRAY"), F.col(f"t{c}")).alias(c) for c in "xy"))

    while True:
        level = materialize(judged(level), "json")
        same = F.col("nx").eqNullSafe(F.col("ny"))
        found.append(level.where(~same).select(key, "at", "path", "nx", "ny"))
        inner = level.where(same & F.col("x").isNotNull() & (F.col("x") != F.col("y")))
        if inner.isEmpty():
            break
        # the text of a variant has its keys in order, so that equal keys lie at equal places
        fields = lambda c: F.map_filter(F.from_json(c, "map<string,variant>"), lambda k, v: ~F.array_contains(hidden, k))
        objects = inner.where("nx.kind = 'OBJECT'").select(key, "at", "path", fields("x").alias("x"), fields("y").alias("y"))
        objects = objects.select(key, "at", "path", F.explode(F.arrays_zip(F.map_keys("x").alias("step"), F.map_values("x").alias("x"), F.map_values("y").alias("y"))).alias("c"))
        objects = objects.select(key, "at", "path", F.col("c.step").alias("step"), F.concat(F.lit("."), "c.step").alias("more"), "c.x", "c.y")
        arrays = inner.where("nx.kind = 'ARRAY'").select(key, "at", "path", F.posexplode(F.arrays_zip(*(F.from_json(c, "array<variant>").alias(c) for c in "xy"))).alias("pos", "c"))
        arrays = arrays.select(key, "at", "path", F.format_string("%010d", "pos").alias("step"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")).alias("more"), "c.x", "c.y")
        below = objects.unionByName(arrays)
        level = below.select(key, F.concat("at", F.array("step")).alias("at"), F.concat("path", "more").alias("path"), *(F.coalesce(F.to_json(c), F.lit("null")).alias(c) for c in "xy"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    what = F.when(F.col("nx.kind") != F.col("ny.kind"), "type").when(F.col("nx.kind") == "OBJECT", "keys").when(F.col("nx.kind") == "ARRAY", "length").otherwise("value")
    only = lambda s, t: F.array_join(F.array_except(F.split(f"n{s}.value", ","), F.split(f"n{t}.value", ",")), ",")
    pick = lambda s, t: F.when(what == "type", F.col(f"n{s}.kind")).when(what == "keys", only(s, t)).otherwise(F.col(f"n{s}.value"))
    each = out.select(key, "at", F.struct("path", what.alias("what"), pick("x", "y").alias("left"), pick("y", "x").alias("right")).alias("d"))
    return each.groupBy(key).agg(F.min_by("d", "at").alias("d")).select(key, "d.*")
