"""Dotted paths to columns, for tables with a schema and for schema-free ones.

A ``Field`` knows how to test and compare the value at a path without ever raising, for Catalyst may
reorder conditions. Missing and null are the same. Comparisons are null where a value is missing or
of another type: a filter takes that as false, and scans can be asked to apply a bare comparison;
``sure`` makes it false where a condition is negated or shown.
"""

from __future__ import annotations

import datetime as dt
import json
import operator
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def false() -> Column:
    return F.lit(False)


def kind_of(value: Any) -> str:
    """bool, number, string, time, list, object or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (dt.date, dt.datetime)):
        return "time"
    if isinstance(value, (list, tuple)):
        return "list"
    if isinstance(value, dict):
        return "object"
    raise TypeError(f"unsupported operand {value!r}")


ORDER = {"$eq": operator.eq, "$gt": operator.gt, "$gte": operator.ge, "$lt": operator.lt, "$lte": operator.le}


def as_time(value: Any) -> dt.datetime | None:
    """A date, a time or ISO text as a time; None if the text is neither."""
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    try:
        return dt.datetime.fromisoformat(value)
    except (TypeError, ValueError):
        return None


def sure(condition: Column) -> Column:
    """Null as false."""
    return F.coalesce(condition, false())


class Field:
    """The value at a path. Subclasses give ``is_null`` and one typed column for each kind of operand."""

    def is_null(self) -> Column:
        raise NotImplementedError

    def as_kind(self, kind: str, value: Any) -> Column | None:
        """A column comparable with an operand of this kind, null where the value is of another; None if never."""
        raise NotImplementedError

    def text(self) -> Column:
        """The value as text for patterns; null if there is none."""
        raise NotImplementedError

    def column(self) -> Column:
        raise NotImplementedError

    def equals_nested(self, value: Any) -> Column:
        raise NotImplementedError

    def is_time(self) -> bool:
        """Whether the values are known to be points in time."""
        return False

    def equals(self, value: Any) -> Column:
        kind = kind_of(value)
        if kind == "null":
            return self.is_null()
        if kind in ("list", "object"):
            return self.equals_nested(value)
        return self.compare("$eq", value)

    def compare(self, op: str, value: Any, strict: bool = False) -> Column:
        kind = kind_of(value)
        c = None if kind in ("null", "list", "object") else self.as_kind(kind, value)
        if c is None:
            if strict:
                raise TypeError(f"{op} can't compare with {value!r} here")
            return false()
        return ORDER[op](c, F.lit(value))

    def one_of(self, values: list) -> Column:
        by_kind: dict[str, list] = {}
        for v in values:
            by_kind.setdefault(kind_of(v), []).append(v)
        parts = []
        for kind, own in by_kind.items():
            if kind == "null":
                parts.append(self.is_null())
            elif kind in ("list", "object"):
                parts += [self.equals(v) for v in own]
            elif self.is_time():
                parts += [self.equals(v) for v in own]
            elif (c := self.as_kind(kind, own[0])) is not None:
                parts.append(c.isin(own))
        return reduce(lambda a, b: a | b, parts) if parts else false()


class TypedField(Field):
    def __init__(self, column: Column | None, dtype: T.DataType | None):
        self.c, self.dtype = column, dtype

    def column(self) -> Column:
        return F.lit(None) if self.c is None else self.c

    def is_null(self) -> Column:
        return F.lit(True) if self.c is None else self.c.isNull()

    def as_kind(self, kind: str, value: Any) -> Column | None:
        own = self.dtype
        if isinstance(own, T.BooleanType):
            return self.c if kind == "bool" else None
        if isinstance(own, T.NumericType):
            return self.c if kind == "number" else None
        if isinstance(own, (T.StringType, T.CharType, T.VarcharType)):
            return self.c if kind == "string" else None
        if isinstance(own, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            if kind == "time" or (kind == "string" and as_time(value)):
                return self.c
        return None

    def is_time(self) -> bool:
        return isinstance(self.dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))

    def compare(self, op: str, value: Any, strict: bool = False) -> Column:
        """Times and ISO text are compared with a bare column as literals, so that scans can skip by them."""
        at = as_time(value) if self.is_time() and kind_of(value) in ("time", "string") else None
        if at is None:
            return super().compare(op, value, strict)
        if isinstance(self.dtype, T.DateType):
            day, whole = F.lit(at.date()), at.time() == dt.time()
            if whole:
                return ORDER[op](self.c, day)
            # Between two days: what is after the time is after its day.
            return false() if op == "$eq" else ORDER["$gt" if op in ("$gt", "$gte") else "$lte"](self.c, day)
        kind = "timestamp_ntz" if isinstance(self.dtype, T.TimestampNTZType) else "timestamp"
        return ORDER[op](self.c, F.lit(at.isoformat(" ")).cast(kind))

    def text(self) -> Column:
        if self.c is None or isinstance(self.dtype, (T.ArrayType, T.StructType, T.MapType, T.BinaryType)):
            return F.lit(None).cast("string")
        if isinstance(self.dtype, T.BooleanType):
            return F.when(self.c, "True").when(~self.c, "False")
        return self.c.cast("string")

    def equals_nested(self, value: Any) -> Column:
        if isinstance(value, dict):
            if not isinstance(self.dtype, T.StructType):
                return false()
            out = self.c.isNotNull()
            for f in self.dtype.fields:
                out = out & TypedField(self.c.getField(f.name), f.dataType).equals(value.get(f.name))
            known = {f.name for f in self.dtype.fields}
            return out if all(v is None for k, v in value.items() if k not in known) else false()
        if not isinstance(self.dtype, T.ArrayType):
            return false()
        out = F.size(self.c) == len(value)
        for i, v in enumerate(value):
            out = out & TypedField(F.get(self.c, F.lit(i)), self.dtype.elementType).equals(v)
        return out

    @staticmethod
    def at(schema: T.StructType, path: str) -> TypedField:
        """Walks structs only; a path that leads nowhere is null."""
        column, dtype = None, schema
        for part in path.split("."):
            if not isinstance(dtype, T.StructType) or part not in dtype.fieldNames():
                return TypedField(None, None)
            dtype = dtype[part].dataType
            column = F.col(f"`{part}`") if column is None else column.getField(part)
        return TypedField(column, dtype)


class VariantField(Field):
    """A path in a VARIANT column. Every extraction is guarded by the stored type, for casts would coerce."""

    def __init__(self, base: Column, path: str):
        steps = "".join('["' + p.replace("\\", "\\\\").replace('"', '\\"') + '"]' for p in path.split("."))
        self.base, self.path = base, "$" + steps

    def column(self) -> Column:
        return F.try_variant_get(self.base, self.path, "variant")

    def kind(self) -> Column:
        return F.schema_of_variant(self.column())

    def is_null(self) -> Column:
        c = self.column()
        return c.isNull() | sure(F.is_variant_null(c))

    def _get(self, guard: Column, kind: str) -> Column:
        return F.when(guard, F.try_variant_get(self.base, self.path, kind))

    def as_kind(self, kind: str, value: Any) -> Column | None:
        own = self.kind()
        if kind == "bool":
            return self._get(own == "BOOLEAN", "boolean")
        if kind == "string":
            return self._get(own == "STRING", "string")
        if kind == "number":
            if isinstance(value, int) and abs(value) > 1 << 53:
                return self._get(own == "BIGINT", "bigint")
            return self._get(own.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL.*|FLOAT|DOUBLE)$"), "double")
        if kind == "time":
            return self._get(own.rlike("^(TIMESTAMP.*|DATE)$"), "timestamp")
        return None

    def text(self) -> Column:
        own, c = self.kind(), self.column()
        truth = F.try_variant_get(self.base, self.path, "boolean")
        scalar = ~own.rlike("^(ARRAY|OBJECT|VOID)")
        return F.when(own == "BOOLEAN", F.when(truth, "True").otherwise("False")).when(scalar, c.cast("string"))

    def equals_nested(self, value: Any) -> Column:
        want = F.to_json(F.parse_json(F.lit(json.dumps(value))))
        return F.when(self.kind().rlike("^(ARRAY|OBJECT)"), F.to_json(self.column()) == want)
