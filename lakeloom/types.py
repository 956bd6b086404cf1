"""Type names of frames and Spark's types."""

from __future__ import annotations

from typing import Any

from pyspark.sql import types as T

from .errors import SchemaError

#: The names that a schema may use.
NAMES: dict[str, T.DataType] = {
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "int": T.LongType(),
    "integer": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(),
    "half": T.FloatType(),
    "float32": T.FloatType(),
    "float": T.FloatType(),
    "float64": T.DoubleType(),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "utf8": T.StringType(),
    "text": T.StringType(),
    "boolean": T.BooleanType(),
    "bool": T.BooleanType(),
    "datetime": T.TimestampNTZType(),
    "timestamp": T.TimestampNTZType(),
    "date": T.DateType(),
    "date32": T.DateType(),
    "binary": T.BinaryType(),
    "bytes": T.BinaryType(),
}


def spark_type(name: str, strict: bool = True) -> T.DataType:
    found = NAMES.get(name.strip().lower())
    if found is None and strict:
        raise SchemaError(f"Unknown type '{name}'")
    return found if found is not None else T.StringType()


def type_name(kind: T.DataType) -> str:
    """The first name that stands for a type."""
    for name, known in NAMES.items():
        if known == kind:
            return name
    raise SchemaError(f"No type name for {kind.simpleString()}")


def _name_of(spec: Any) -> str:
    """The type name in one field of the list form: a string, or an object with a name."""
    if isinstance(spec, str):
        return spec
    if isinstance(spec, dict):
        name, bits = str(spec.get("name", "")).lower(), spec.get("bitWidth")
        if name == "int" and bits:
            return ("int" if spec.get("isSigned", True) else "uint") + str(bits)
        if name == "floatingpoint":
            return {"HALF": "float16", "SINGLE": "float32"}.get(str(spec.get("precision")), "float64")
        if name:
            return name
    return "string"


def spark_schema(schema: Any, strict: bool = False) -> T.StructType:
    """From {name: type} or {"fields": [{"name", "type" or "data_type", "nullable"}]}; fields keep their order.

    Unknown names become strings unless ``strict``.
    """
    if not isinstance(schema, dict):
        raise SchemaError("Schema must be a JSON object mapping field names to types")
    fields = schema.get("fields")
    if isinstance(fields, list):
        if not all(isinstance(f, dict) and "name" in f for f in fields):
            raise SchemaError("Each entry of 'fields' needs a name")
        pairs = [(f["name"], _name_of(f.get("data_type", f.get("type", "string"))), bool(f.get("nullable", True))) for f in fields]
    else:
        pairs = [(k, v if isinstance(v, str) else _name_of(v), True) for k, v in schema.items()]
    return T.StructType([T.StructField(n, spark_type(t, strict), nullable) for n, t, nullable in pairs])
