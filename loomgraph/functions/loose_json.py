"""JSON out of text that has more around it: the value's own span, then Spark's variant type."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, functions as F

_SPAN = pa.struct([("body", pa.string()), ("reason", pa.string())])


class Repeated(ValueError):
    pass


def _unique(pairs: list[tuple]) -> dict:
    found = {}
    for key, value in pairs:
        if key in found:
            raise Repeated(key)
        found[key] = value
    return found


def balanced(text: str, opening: str) -> str | None:
    """The first span from an opening bracket to the one that closes it; brackets inside strings don't count. None if it never closes."""
    start = text.find(opening)
    depth, quoted, escaped = 0, False, False
    for at in range(start, len(text)) if start >= 0 else ():
        char = text[at]
        if quoted:
            quoted, escaped = escaped or char != '"', not escaped and char == "\\"
        elif char == '"':
            quoted = True
        elif char in "[{":
            depth += 1
        elif char in "]}":
            depth -= 1
            if not depth:
                return text[start : at + 1]
    return None


def span(text: str | None, kind: str) -> tuple[str | None, str | None]:
    """(body, reason): the text of the first array or object, or why there is none: `empty`, `absent`, `unclosed`, `repeated field` or `invalid`."""
    if text is None or not text.strip():
        return None, "empty"
    opening = "[" if kind == "array" else "{"
    if opening not in text:
        return None, "absent"
    body = balanced(text, opening)
    if body is None:
        return None, "unclosed"
    try:
        json.loads(body, object_pairs_hook=_unique, parse_constant=lambda name: 1 / 0)
    except Repeated as repeat:
        return None, f"repeated field: {repeat}"
    except (ValueError, ZeroDivisionError, RecursionError):
        return None, "invalid"
    return body, None


def found(text: Column, kind: str = "array") -> Column:
    """Struct (value variant, reason): the first array (or object) in a text, whatever stands around it; one of both is null.

    A field that an object has twice makes the whole invalid, as do NaN and Infinity.
    """
    if kind not in ("array", "object"):
        raise ValueError("kind: array or object")

    def each(texts: pa.Array) -> pa.Array:
        rows = [span(t.as_py(), kind) for t in texts]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], fields=list(_SPAN))

    cut = F.arrow_udf(each, "body string, reason string")(text)
    value = F.try_parse_json(cut["body"])
    return F.struct(value.alias("value"), F.when(cut["body"].isNotNull() & value.isNull(), "invalid").otherwise(cut["reason"]).alias("reason"))


def field_faults(value: Column, expected: Sequence[str]) -> Column:
    """What is wrong with an object's fields: `not an object`, `missing: a, b; unknown: c`, or null. Names in order."""
    keys = F.map_keys(F.try_variant_get(value, "$", "map<string, variant>"))
    wanted = F.array(*map(F.lit, sorted(expected)))
    told = [(F.array_sort(F.array_except(wanted, keys)), "missing: "), (F.array_sort(F.array_except(keys, wanted)), "unknown: ")]
    parts = F.array_compact(F.array(*[F.when(F.size(names) > 0, F.concat(F.lit(word), F.array_join(names, ", "))) for names, word in told]))
    return F.when(keys.isNull(), "not an object").otherwise(F.nullif(F.array_join(parts, "; "), F.lit("")))
