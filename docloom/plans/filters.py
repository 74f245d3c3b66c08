"""Filter documents to conditions.

``{"city": "Rome", "age": {"$gte": 18}, "$or": [...]}`` becomes one ``Column``, built from
comparisons that Parquet scans can be asked to apply.
"""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.fields import Field, TypedField, VariantField, false, kind_of, sure

COMPARISONS = {"$gt", "$gte", "$lt", "$lte"}


class Fields:
    """Where paths lead: in a table's columns, or in its VARIANT column ``doc`` for schema-free ones."""

    def __init__(self, df: DataFrame, doc: str | None = None):
        self.schema = df.schema
        if doc is None and "doc" in df.columns and isinstance(df.schema["doc"].dataType, T.VariantType):
            doc = "doc"
        self.doc = doc

    def __call__(self, path: str) -> Field:
        top = path.split(".")[0]
        if self.doc is None or (top in self.schema.fieldNames() and top != self.doc):
            return TypedField.at(self.schema, path)
        return VariantField(F.col(self.doc), path)


def java_pattern(pattern: str) -> str:
    """A pattern in Python's spelling: Unicode-aware classes, named groups renamed."""
    return "(?U)" + re.sub(r"\(\?P<", "(?<", re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern))


def compile_filter(query: dict[str, Any], fields: Fields, lenient: bool = False, strict: bool = False) -> Column:
    """The condition for ``query``, true or false for every row.

    ``lenient`` ignores unknown operators (they hold), else they raise ``ValueError``. ``strict``
    raises ``TypeError`` for order comparisons that can never hold by type, else they don't match.
    """
    return sure(predicate(query, fields, lenient, strict))


def predicate(query: dict[str, Any], fields: Fields, lenient: bool = False, strict: bool = False) -> Column:
    """The same for ``where``, which takes null as false: bare comparisons, that scans understand."""
    return _all([_clause(k, v, fields, lenient, strict) for k, v in query.items()])


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _any(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, parts) if parts else false()


def _not(part: Column) -> Column:
    return ~sure(part)


def _clause(key: str, value: Any, fields: Fields, lenient: bool, strict: bool) -> Column:
    if key in ("$and", "$or", "$nor"):
        if not isinstance(value, (list, tuple)) or not value:
            raise ValueError(f"{key} needs a list of filters")
        parts = [predicate(q, fields, lenient, strict) for q in value]
        return _all(parts) if key == "$and" else _any(parts) if key == "$or" else _not(_any(parts))
    if key == "$not":
        return _not(predicate(value, fields, lenient, strict))
    if key.startswith("$"):
        if lenient:
            return F.lit(True)
        raise ValueError(f"unknown operator {key}")
    return condition(fields(key), value, lenient, strict)


def condition(field: Field, value: Any, lenient: bool = False, strict: bool = False) -> Column:
    """A field against a value or a map of operators; a map without operators is a nested value."""
    if not isinstance(value, dict):
        return field.equals(value)
    marked = [str(k).startswith("$") for k in value]
    if not all(marked):
        if any(marked):
            raise ValueError(f"operators and keys are mixed in {value!r}")
        return field.equals(value)
    return _all([_operator(field, op, v, lenient, strict) for op, v in value.items()])


def _operator(field: Field, op: str, v: Any, lenient: bool, strict: bool) -> Column:
    if op == "$eq":
        return field.equals(v)
    if op == "$ne":
        return _not(field.equals(v))
    if op in COMPARISONS:
        return field.compare(op, v, strict)
    if op in ("$in", "$nin"):
        if kind_of(v) != "list":
            raise ValueError(f"{op} needs a list")
        found = field.one_of(list(v))
        return found if op == "$in" else _not(found)
    if op == "$regex":
        return field.text().rlike(java_pattern(v))
    if op == "$exists":
        if not isinstance(v, (bool, int, float)) or v not in (0, 1):
            return false()
        return ~field.is_null() if v else field.is_null()
    if op == "$not":
        return _not(condition(field, v, lenient, strict))
    if op == "$mod":
        c = field.as_kind("number", 0)
        return false() if c is None else F.pmod(c, F.lit(v[0])) == F.pmod(F.lit(v[1]), F.lit(v[0]))
    if op in ("$size", "$contains", "$all", "$overlaps", "$elemMatch"):
        return _array_operator(field, op, v, lenient, strict)
    if op == "$type":
        kinds = v if isinstance(v, (list, tuple)) else [v]
        return _any([_is_kind(field, k) for k in kinds])
    if lenient:
        return F.lit(True)
    raise ValueError(f"unknown operator {op}")


def _elements(field: Field) -> tuple[Column, T.DataType] | None:
    if isinstance(field, TypedField):
        return (field.c, field.dtype.elementType) if isinstance(field.dtype, T.ArrayType) else None
    guard = field.kind().startswith("ARRAY")
    return F.when(guard, F.try_variant_get(field.base, field.path, "array<variant>")), T.VariantType()


def _array_operator(field: Field, op: str, v: Any, lenient: bool, strict: bool) -> Column:
    found = _elements(field)
    if found is None:
        return false()
    items, kind = found

    def holds(test: Any):
        if isinstance(kind, T.VariantType):
            return lambda e: condition(_Element(e), test, lenient, strict)
        if isinstance(kind, T.StructType) and isinstance(test, dict) and not any(k.startswith("$") for k in test):
            return lambda e: _all([condition(TypedField(e.getField(k), kind[k].dataType) if k in kind.fieldNames() else TypedField(None, None), x, lenient, strict) for k, x in test.items()])
        return lambda e: condition(TypedField(e, kind), test, lenient, strict)

    if op == "$size":
        return F.size(items) == F.lit(v)
    if op == "$contains":
        return F.exists(items, holds(v))
    if op == "$overlaps":
        return _any([F.exists(items, holds(x)) for x in v])
    if op == "$all":
        return _all([~field.is_null(), *[F.exists(items, holds(x)) for x in v]])
    return F.exists(items, holds(v))


class _Element(VariantField):
    """An element of a VARIANT array, or what is at a key inside it."""

    def __init__(self, base: Column):
        self.base, self.path = base, "$"


def _is_kind(field: Field, kind: str) -> Column:
    if kind == "null":
        return field.is_null()
    if kind in ("bool", "number", "string"):
        c = field.as_kind(kind, {"bool": True, "number": 0, "string": ""}[kind])
        return false() if c is None else c.isNotNull()
    if isinstance(field, TypedField):
        is_ = isinstance(field.dtype, T.ArrayType if kind == "array" else T.StructType)
        return field.c.isNotNull() if is_ else false()
    return field.kind().startswith("ARRAY" if kind == "array" else "OBJECT")


def find(df: DataFrame, query: dict[str, Any] | None = None, limit: int | None = None, skip: int = 0, sort: list[tuple[str, int]] | None = None, id_col: str = "_id", **flags) -> DataFrame:
    """Rows that match, in order of id if there is a limit; ``limit=0`` gives none."""
    out = df.where(predicate(query, Fields(df), **flags)) if query else df
    if limit is None and not skip and not sort:
        return out
    if (limit is not None and limit < 0) or skip < 0:
        raise ValueError("limit and skip can't be negative")
    fields = Fields(df)
    keys = [F.asc_nulls_first(_sort_key(fields(p))) if way > 0 else F.desc_nulls_last(_sort_key(fields(p))) for p, way in sort or []]
    out = out.orderBy(*keys, F.col(id_col)) if id_col in df.columns else (out.orderBy(*keys) if keys else out)
    out = out.offset(skip) if skip else out
    return out if limit is None else out.limit(limit)


def _sort_key(field: Field) -> Column:
    if isinstance(field, TypedField):
        return field.column()
    # Numbers before text before truth values, each in its own order.
    number, text, truth = (field.as_kind(k, v) for k, v in (("number", 0), ("string", ""), ("bool", True)))
    rank = F.when(number.isNotNull(), 1).when(text.isNotNull(), 2).when(truth.isNotNull(), 3).otherwise(4)
    return F.when(~field.is_null(), F.struct(rank.alias("r"), number.alias("n"), text.alias("s"), truth.alias("b"), F.to_json(field.column()).alias("j")))


def count(df: DataFrame, query: dict[str, Any] | None = None) -> int:
    """How many rows match, without a cap."""
    return find(df, query).count()


def page(df: DataFrame, query: dict[str, Any] | None, skip: int, limit: int, sort: list[tuple[str, int]] | None = None, id_col: str = "_id") -> dict[str, Any]:
    """A page with the total and whether more follows."""
    total = count(df, query)
    return {"rows": find(df, query, limit, skip, sort, id_col), "total": total, "has_more": skip + limit < total}
