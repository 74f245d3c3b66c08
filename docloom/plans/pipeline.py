"""Aggregation pipelines: a list of stages folded over a DataFrame, one lazy plan in the end."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.fields import Field, TypedField, VariantField
from docloom.plans.filters import Fields, _sort_key, predicate


def aggregate(df: DataFrame, stages: list[dict[str, Any]], id_col: str = "_id", legacy_sort: bool = False, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Apply ``stages`` in order; each is a dict with one known key.

    ``legacy_sort`` makes the last key of a ``$sort`` the first in rank. ``tables`` are the
    collections that ``$lookup`` and the set stages may name. ``$first``, ``$last`` and ``$push`` go by
    the order of a ``$sort`` right before the ``$group``, else by id.
    """
    context: dict[str, Any] = {"id": id_col, "legacy_sort": legacy_sort, "tables": tables or {}}
    for stage in stages:
        if len(stage) != 1:
            raise ValueError(f"a stage has one key: {stage!r}")
        (name, spec), *_ = stage.items()
        if name not in STAGES:
            raise ValueError(f"unknown stage {name}")
        df = STAGES[name](df, spec, context)
        context["sorted"] = spec if name == "$sort" else context.get("sorted") if name == "$match" else None
    return df


def _match(df: DataFrame, spec: dict, _: dict) -> DataFrame:
    return df.where(predicate(spec, Fields(df)))


def _path(spec: Any) -> str:
    if not isinstance(spec, str) or not spec.startswith("$"):
        raise ValueError(f"'$field' expected, not {spec!r}")
    return spec[1:]


def _key(field: Field) -> Column:
    """Something that rows can be grouped by: VARIANT can't, so its text stands for it."""
    if isinstance(field, VariantField):
        return F.when(field.is_null(), None).otherwise(F.coalesce(field.as_kind("string", ""), F.to_json(field.column())))
    return field.column()


def _number(field: Field) -> Column:
    c = field.as_kind("number", 0)
    return F.lit(None).cast("double") if c is None else c


def _ordered(field: Field) -> Column:
    return field.column() if isinstance(field, TypedField) else F.coalesce(field.as_kind("string", ""), F.to_json(field.column()))


def _accumulator(op: str, spec: Any, fields: Fields, order: Column) -> Column:
    if op == "$count":
        return F.count("*")
    if op == "$countIf":
        return F.count_if(predicate(spec, fields))
    if op == "$countDistinct":
        return F.count_distinct(_key(fields(_path(spec))))
    if op == "$sum" and isinstance(spec, (int, float)) and not isinstance(spec, bool):
        return F.count("*") * F.lit(spec) if spec != 1 else F.count("*")
    field = fields(_path(spec))
    typed = isinstance(field, TypedField)
    if op == "$sum":
        return F.coalesce(F.sum(_number(field)), F.lit(0))
    if op == "$avg":
        return F.avg(_number(field))
    if op in ("$min", "$max"):
        value = field.column() if typed else F.coalesce(_number(field).cast("string"), _ordered(field))
        if not typed:  # numbers rank among themselves, text among itself
            pick = F.min if op == "$min" else F.max
            return F.coalesce(pick(_number(field)).cast("string"), pick(field.as_kind("string", "")))
        return F.min(value) if op == "$min" else F.max(value)
    if op == "$first":
        return F.min_by(_ordered(field), order)
    if op == "$last":
        return F.max_by(_ordered(field), order)
    if op == "$push":  # in order of id
        pairs = F.array_sort(F.collect_list(F.struct(order.alias("k"), _ordered(field).alias("v"))))
        return F.transform(pairs, lambda p: p["v"])
    if op == "$addToSet":
        return F.array_sort(F.collect_set(_ordered(field)))
    raise ValueError(f"unknown accumulator {op}")


def _group(df: DataFrame, spec: dict, context: dict) -> DataFrame:
    """``_id``: '$field', a dict of fields (one column for each), or None for one group of all rows."""
    fields = Fields(df)
    key = spec.get("_id")
    order = F.col(context["id"]) if context["id"] in df.columns else F.monotonically_increasing_id()
    if context.get("sorted"):
        order = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(_ranks(fields, context["sorted"], context["legacy_sort"]))], order.alias("id"))
    aggs = []
    for name, acc in spec.items():
        if name == "_id":
            continue
        if not isinstance(acc, dict) or len(acc) != 1:
            raise ValueError(f"an accumulator has one operator: {acc!r}")
        (op, arg), *_ = acc.items()
        aggs.append(_accumulator(op, arg, fields, order).alias(name))
    if key is None:
        return df.agg(*(aggs or [F.count("*").alias("count")]))
    if isinstance(key, dict):
        keys = [_key(fields(_path(p))).alias(k) for k, p in key.items()]
    else:
        keys = [_key(fields(_path(key))).alias("_id")]
    return df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct()


def _keys(spec: dict, legacy: bool) -> list[tuple[str, int]]:
    return list(spec.items())[:: -1 if legacy else 1]


def _ranks(fields: Fields, spec: dict, legacy: bool) -> list[Column]:
    """Columns that grow in the order of a ``$sort``, for picking the first or last row of a group."""
    out = []
    for path, way in _keys(spec, legacy):
        field = fields(path)
        typed = isinstance(field, TypedField)
        if way > 0:
            out.append(F.struct(field.is_null().cast("int").alias("n") * -1, _sort_key(field).alias("v")) if typed else _sort_key(field))
        elif typed and isinstance(field.dtype, (T.NumericType, T.BooleanType)):
            out.append(F.struct(field.is_null().cast("int").alias("n"), (-field.column().cast("double" if not isinstance(field.dtype, T.DecimalType) else field.dtype.simpleString())).alias("v")))
        else:
            raise ValueError(f"$first, $last and $push after a falling $sort need a number, not {path!r}")
    return out


def _sort(df: DataFrame, spec: dict, context: dict) -> DataFrame:
    """Nulls first going up, last going down; ties in order of id."""
    fields = Fields(df)
    keys = _keys(spec, context["legacy_sort"])
    order = [F.asc_nulls_first(_sort_key(fields(k))) if way > 0 else F.desc_nulls_last(_sort_key(fields(k))) for k, way in keys]
    if context["id"] in df.columns and context["id"] not in spec:
        order.append(F.col(context["id"]).asc())
    return df.orderBy(*order)


def _limit(df: DataFrame, n: int, _: dict) -> DataFrame:
    if n < 0:
        raise ValueError("$limit can't be negative")
    return df.limit(n)


def _skip(df: DataFrame, n: int, _: dict) -> DataFrame:
    if n < 0:
        raise ValueError("$skip can't be negative")
    return df.offset(n)


def _project(df: DataFrame, spec: dict, _: dict) -> DataFrame:
    """Names with a true value are kept, a dotted path as a flat column of that name; '$path' renames.

    If all values are false, those top-level fields go and all others stay.
    """
    fields = Fields(df)
    if spec and not any(spec.values()):
        if any("." in name for name in spec):
            raise ValueError("$project leaves out top-level fields only")
        out_of = df.drop(*spec)
        if fields.doc is None:
            return out_of
        left = F.map_filter(F.col(fields.doc).cast("map<string,variant>"), lambda k, _: ~k.isin(list(spec)))
        return out_of.withColumn(fields.doc, F.to_variant_object(left)) if fields.doc in out_of.columns else out_of
    out = []
    for name, v in spec.items():
        if isinstance(v, str) and v.startswith("$"):
            out.append(fields(v[1:]).column().alias(name))
        elif v:
            out.append(fields(name).column().alias(name))
    if not out:
        raise ValueError("$project keeps no field")
    return df.select(*out)


def _unwind(df: DataFrame, spec: str | dict, _: dict) -> DataFrame:
    path = _path(spec if isinstance(spec, str) else spec["path"])
    keep = not isinstance(spec, str) and spec.get("preserveNullAndEmptyArrays", False)
    field = Fields(df)(path)
    items = field.column() if isinstance(field, TypedField) else F.try_variant_get(field.base, field.path, "array<variant>")
    return df.withColumn(path, F.explode_outer(items) if keep else F.explode(items))


def _lookup(df: DataFrame, spec: dict, context: dict) -> DataFrame:
    """Left join that gathers the matching rows of another collection in an array."""
    other = context["tables"][spec["from"]]
    left, right = _key(Fields(df)(spec["localField"])), _key(Fields(other)(spec["foreignField"]))
    rows = other.select(right.alias("_k"), F.struct(*[F.col(f"`{c}`") for c in other.columns]).alias("_r"))
    rows = rows.where("_k is not null").groupBy("_k").agg(F.collect_list("_r").alias(spec["as"]))
    out = df.withColumn("_l", left).join(rows, F.col("_l") == F.col("_k"), "left").drop("_l", "_k")
    return out.withColumn(spec["as"], F.coalesce(F.col(spec["as"]), F.array().cast(rows.schema[spec["as"]].dataType)))


def _union(df: DataFrame, spec: str, context: dict) -> DataFrame:
    return df.unionByName(context["tables"][spec], allowMissingColumns=True)


def intersect(df: DataFrame, other: DataFrame, all: bool = False) -> DataFrame:
    """Rows that both have, by the columns of ``df``; each once, or as often as both with ``all``."""
    other = other.select(*[f"`{c}`" for c in df.columns])
    return df.intersectAll(other) if all else df.intersect(other)


def subtract(df: DataFrame, other: DataFrame, all: bool = False) -> DataFrame:
    """Rows of ``df`` that ``other`` has not; with ``all`` every row there takes away one here."""
    other = other.select(*[f"`{c}`" for c in df.columns])
    return df.exceptAll(other) if all else df.subtract(other)


def _add(df: DataFrame, spec: dict, _: dict) -> DataFrame:
    fields = Fields(df)
    return df.withColumns({k: _value(v, fields) for k, v in spec.items()})


def _value(v: Any, fields: Fields) -> Column:
    """'$path', a constant, or {'$setUnion': ['$a', '$b']}: the elements of both arrays, each once."""
    if isinstance(v, dict) and list(v) == ["$setUnion"]:
        arrays = [fields(_path(p)) for p in v["$setUnion"]]
        columns = [f.column() if isinstance(f, TypedField) else F.transform(F.try_variant_get(f.base, f.path, "array<variant>"), lambda e: F.to_json(e)) for f in arrays]
        return reduce(F.array_union, columns)
    return fields(v[1:]).column() if isinstance(v, str) and v.startswith("$") else F.lit(v)


STAGES = {
    "$match": _match,
    "$group": _group,
    "$sort": _sort,
    "$limit": _limit,
    "$skip": _skip,
    "$project": _project,
    "$unwind": _unwind,
    "$lookup": _lookup,
    "$unionWith": _union,
    "$intersectWith": lambda df, spec, context: intersect(df, context["tables"][spec]),
    "$exceptWith": lambda df, spec, context: subtract(df, context["tables"][spec]),
    "$addFields": _add,
    "$count": lambda df, name, _: df.agg(F.count("*").alias(name)),
}


def distinct(df: DataFrame, path: str) -> DataFrame:
    """Distinct non-null values at a path, as column ``value``."""
    field = Fields(df)(path)
    return df.select(_key(field).alias("value")).where("value is not null").distinct()


