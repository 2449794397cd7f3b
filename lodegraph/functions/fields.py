"""Access to the free-form ``data`` of a node, strictly by type.

``data`` is a STRUCT or a VARIANT.  A name is a path of dots and may begin
with ``data.``.  In a struct a null field counts as missing; a variant tells
null from missing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


class Fields:
    def __init__(self, nodes: DataFrame, column: str = "data") -> None:
        self.kind = nodes.schema[column].dataType
        self.column = column

    def _path(self, name: str) -> list[str]:
        return name.removeprefix("data.").split(".")

    def type_of(self, name: str) -> T.DataType | None:
        """None where a struct has no such field."""
        kind = self.kind
        if isinstance(kind, T.VariantType):
            return kind
        for part in self._path(name):
            if not isinstance(kind, T.StructType) or part not in kind.names:
                return None
            kind = kind[part].dataType
        return kind

    def raw(self, name: str) -> Column:
        if isinstance(self.kind, T.VariantType):
            return F.try_variant_get(F.col(self.column), self._variant_path(name), "variant")
        if self.type_of(name) is None:
            return F.lit(None)
        out = F.col(self.column)
        for part in self._path(name):
            out = out[part]
        return out

    def _variant_path(self, name: str) -> str:
        return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in self._path(name))

    def _variant_type(self, name: str) -> Column:
        return F.schema_of_variant(self.raw(name))

    def present(self, name: str) -> Column:
        """Neither missing nor null."""
        out = self.raw(name).isNotNull()
        return out & (self._variant_type(name) != "VOID") if isinstance(self.kind, T.VariantType) else out

    def number(self, name: str) -> Column:
        """As a double where it is a finite number (a boolean or a digit string is none), else null."""
        if isinstance(self.kind, T.VariantType):
            ok = self._variant_type(name).rlike(r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$")
            value = F.when(ok, F.try_variant_get(F.col(self.column), self._variant_path(name), "double"))
        elif isinstance(self.type_of(name), _NUMERIC):
            value = self.raw(name).cast("double")
        else:
            return F.lit(None).cast("double")
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)

    def text(self, name: str) -> Column:
        """Any value as text; null where missing or null."""
        if isinstance(self.kind, T.VariantType):
            return F.when(self._variant_type(name) != "VOID", F.coalesce(F.try_variant_get(F.col(self.column), self._variant_path(name), "string"), F.to_json(self.raw(name))))
        kind = self.type_of(name)
        if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
            return F.to_json(self.raw(name))
        return self.raw(name).cast("string")

    def equals(self, name: str, value: object) -> Column:
        """Strict equality: type and value.  None matches an explicit null only."""
        never = F.lit(False)
        if isinstance(self.kind, T.VariantType):
            kind = self._variant_type(name)
            if value is None:
                return F.coalesce(kind == "VOID", never)
            if isinstance(value, bool):
                return F.coalesce((kind == "BOOLEAN") & (F.try_variant_get(F.col(self.column), self._variant_path(name), "boolean") == value), never)
            if isinstance(value, (int, float)):
                return F.coalesce(self.number(name) == float(value), never)
            return F.coalesce((kind == "STRING") & (F.try_variant_get(F.col(self.column), self._variant_path(name), "string") == value), never)
        kind = self.type_of(name)
        if value is None or kind is None:
            return never
        wanted = T.BooleanType if isinstance(value, bool) else _NUMERIC if isinstance(value, (int, float)) else T.StringType
        return F.coalesce(self.raw(name) == F.lit(value), never) if isinstance(kind, wanted) else never

    def key(self, name: str) -> Column:
        """As a group's name: text, whole numbers without a fraction, 'null' where missing or null."""
        kind = self.type_of(name)
        text = self.text(name)
        if isinstance(kind, (T.VariantType, T.DoubleType, T.FloatType)):
            n = self.number(name)
            text = F.when((n == F.floor(n)) & (F.abs(n) < 1e15), F.format_string("%.0f", n)).otherwise(text)
        return F.coalesce(text, F.lit("null"))


def quoted(name: str) -> str:
    return name if re.fullmatch(r"\w+", name) else f"`{name}`"
