"""Values as SQL literals, for column defaults that Spark's reader fills in."""

from __future__ import annotations

from ..format.types import Primitive


def literal(t: Primitive, v) -> str:
    if v is None:
        return "NULL"
    if t.is_decimal:
        return f"CAST('{v}' AS DECIMAL({t.decimal[0]},{t.decimal[1]}))"
    if t.name == "string":
        return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if t.name == "date":
        return f"DATE'{v.isoformat()}'"
    if t.name == "timestamp":
        return f"TIMESTAMP_NTZ'{v.isoformat(' ')}'"
    if t.name == "timestamptz":
        return f"TIMESTAMP'{v.isoformat(' ')}'"
    if t.name == "boolean":
        return "true" if v else "false"
    if t.name == "uuid":
        return f"X'{v.hex}'"
    if t.name == "binary" or t.fixed_length is not None:
        return f"X'{bytes(v).hex()}'"
    kind = {"int": "INT", "long": "BIGINT", "float": "FLOAT", "double": "DOUBLE"}[t.name]
    return f"CAST('{v}' AS {kind})"
