"""Native types of each engine, canonical types, and Spark's."""

from __future__ import annotations

from pyspark.sql import types as T

from ..model import CanonicalType, ConnectorError, Kind

K = Kind
# Native names by engine, to and from canonical kinds.
TO_CANONICAL = {
    "postgres": {"varchar": K.STRING, "bpchar": K.STRING, "text": K.TEXT, "int2": K.INTEGER, "int4": K.INTEGER, "int8": K.LONG, "numeric": K.DECIMAL, "bool": K.BOOLEAN, "date": K.DATE, "timestamp": K.TIMESTAMP, "timestamptz": K.TIMESTAMP, "bytea": K.BINARY, "uuid": K.UUID},
    "mysql": {"varchar": K.STRING, "char": K.STRING, "text": K.TEXT, "longtext": K.TEXT, "tinyint": K.BOOLEAN, "smallint": K.INTEGER, "int": K.INTEGER, "bigint": K.LONG, "decimal": K.DECIMAL, "numeric": K.DECIMAL, "date": K.DATE, "datetime": K.TIMESTAMP, "timestamp": K.TIMESTAMP, "blob": K.BINARY, "varbinary": K.BINARY, "binary": K.BINARY},
    "oracle": {"varchar2": K.STRING, "nvarchar2": K.STRING, "char": K.STRING, "clob": K.TEXT, "nclob": K.TEXT, "date": K.DATE, "timestamp": K.TIMESTAMP, "blob": K.BINARY, "raw": K.BINARY},
    "sqlserver": {"nvarchar": K.STRING, "varchar": K.STRING, "nchar": K.STRING, "char": K.STRING, "text": K.TEXT, "ntext": K.TEXT, "int": K.INTEGER, "smallint": K.INTEGER, "bigint": K.LONG, "decimal": K.DECIMAL, "numeric": K.DECIMAL, "bit": K.BOOLEAN, "date": K.DATE, "datetime2": K.TIMESTAMP, "datetime": K.TIMESTAMP, "varbinary": K.BINARY, "binary": K.BINARY, "uniqueidentifier": K.UUID},
    "mongodb": {"string": K.STRING, "objectid": K.STRING, "int32": K.INTEGER, "int64": K.LONG, "double": K.DECIMAL, "decimal128": K.DECIMAL, "bool": K.BOOLEAN, "date": K.TIMESTAMP, "bindata": K.BINARY, "array": K.TEXT, "object": K.TEXT},
}
FROM_CANONICAL = {
    "postgres": {K.STRING: "varchar", K.TEXT: "text", K.INTEGER: "integer", K.LONG: "bigint", K.DECIMAL: "numeric", K.BOOLEAN: "boolean", K.DATE: "date", K.TIMESTAMP: "timestamp", K.BINARY: "bytea", K.UUID: "uuid", K.DOUBLE: "double precision"},
    "mysql": {K.STRING: "varchar", K.TEXT: "text", K.INTEGER: "int", K.LONG: "bigint", K.DECIMAL: "decimal", K.BOOLEAN: "tinyint", K.DATE: "date", K.TIMESTAMP: "datetime", K.BINARY: "blob", K.UUID: "char", K.DOUBLE: "double"},
    "oracle": {K.STRING: "varchar2", K.TEXT: "clob", K.INTEGER: "number", K.LONG: "number", K.DECIMAL: "number", K.BOOLEAN: "number", K.DATE: "date", K.TIMESTAMP: "timestamp", K.BINARY: "blob", K.UUID: "raw", K.DOUBLE: "binary_double"},
    "sqlserver": {K.STRING: "nvarchar", K.TEXT: "nvarchar", K.INTEGER: "int", K.LONG: "bigint", K.DECIMAL: "decimal", K.BOOLEAN: "bit", K.DATE: "date", K.TIMESTAMP: "datetime2", K.BINARY: "varbinary", K.UUID: "uniqueidentifier", K.DOUBLE: "float"},
    "mongodb": {K.STRING: "string", K.TEXT: "string", K.INTEGER: "int32", K.LONG: "int64", K.DECIMAL: "decimal128", K.BOOLEAN: "bool", K.DATE: "date", K.TIMESTAMP: "date", K.BINARY: "bindata", K.UUID: "bindata", K.DOUBLE: "double"},
}
ENGINES = tuple(TO_CANONICAL)
#: Precision and scale of Oracle's numbers, and length of its raw identifiers.
ORACLE_NUMBERS = {K.INTEGER: (10, 0), K.LONG: (19, 0), K.BOOLEAN: (1, 0)}
ORACLE_MOST = 38


def to_canonical(engine: str, native: str, length=None, precision=None, scale=None) -> CanonicalType:
    name = native.lower()
    if engine == "oracle" and name == "number":
        if scale:
            return CanonicalType(K.DECIMAL, precision=precision or ORACLE_MOST, scale=scale)
        for most, kind in ((1, K.BOOLEAN), (9, K.INTEGER), (19, K.LONG)):
            if precision is not None and (precision == most if most == 1 else precision <= most):
                return CanonicalType(kind)
        return CanonicalType(K.DECIMAL, precision=precision or ORACLE_MOST, scale=scale or 0)
    kind = TO_CANONICAL.get(engine, {}).get(name)
    if kind is None:
        raise ConnectorError(f"{engine} type {native} has no canonical type")
    return CanonicalType(kind, length, precision, scale)


def from_canonical(engine: str, t: CanonicalType) -> tuple[str, int | None, int | None, int | None]:
    """Native name, length, precision, scale."""
    name = FROM_CANONICAL.get(engine, {}).get(t.kind)
    if name is None:
        raise ConnectorError(f"{engine} has no type for {t.kind.value}")
    length, precision, scale = t.length, t.precision, t.scale
    if engine == "oracle" and t.kind in ORACLE_NUMBERS:
        length, (precision, scale) = None, ORACLE_NUMBERS[t.kind]
    elif engine == "oracle" and t.kind is K.UUID:
        length = 16
    elif engine == "oracle" and t.kind is K.DECIMAL:
        precision, scale = precision or ORACLE_MOST, scale or 0
    elif engine == "mysql" and length is None and t.kind in (K.STRING, K.UUID):
        length = 36 if t.kind is K.UUID else 255  # bare they would be invalid or too short
    elif engine == "oracle" and t.kind is K.STRING and length is None:
        length = 4000
    return name, length, precision, scale


def canonical_of(t: T.DataType) -> CanonicalType:
    """Of a Spark type. Nested types are text."""
    match t:
        case T.VarcharType() | T.CharType():
            return CanonicalType(K.STRING, t.length)
        case T.StringType():
            return CanonicalType(K.STRING)
        case T.ByteType() | T.ShortType() | T.IntegerType():
            return CanonicalType(K.INTEGER)
        case T.LongType():
            return CanonicalType(K.LONG)
        case T.DecimalType():
            return CanonicalType(K.DECIMAL, precision=t.precision, scale=t.scale)
        case T.FloatType() | T.DoubleType():
            return CanonicalType(K.DOUBLE)
        case T.BooleanType():
            return CanonicalType(K.BOOLEAN)
        case T.DateType():
            return CanonicalType(K.DATE)
        case T.TimestampType() | T.TimestampNTZType():
            return CanonicalType(K.TIMESTAMP)
        case T.BinaryType():
            return CanonicalType(K.BINARY)
    return CanonicalType(K.TEXT)


def spark_of(t: CanonicalType) -> T.DataType:
    simple = {K.INTEGER: T.IntegerType(), K.LONG: T.LongType(), K.BOOLEAN: T.BooleanType(), K.DATE: T.DateType(), K.TIMESTAMP: T.TimestampNTZType(), K.BINARY: T.BinaryType(), K.DOUBLE: T.DoubleType()}
    if t.kind is K.DECIMAL:
        return T.DecimalType(min(t.precision or 38, 38), t.scale or 0)
    return simple.get(t.kind, T.StringType())
