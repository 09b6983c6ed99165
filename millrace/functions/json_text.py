"""JSON functions over text.

A null document or argument gives NULL; a malformed document is an error. Paths
know $, .name, ["name"], ['name'] and [n], and tolerate a bare leading name; wildcards and filters are
refused. Of repeated keys the last counts. Values are printed with sorted keys and without spaces.

Each function takes and gives whole Arrow columns, and a batch's documents are parsed once for all
calls on them. Spark's own JSON expressions know neither the last of repeated keys nor an error for
malformed text.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import TransformError

_STEP = re.compile(r"""\.\s*([^.\[\]\s"'*?@()]+)|\[\s*(?:(\d+)|"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')\s*\]""")
_BARE = re.compile(r"""[^.\[\]\s"'*?@()$]+""")
_MISSING = object()


@functools.lru_cache(4096)
def path_steps(path: str) -> tuple[str | int, ...]:
    text, at, steps = path.strip(), 0, []
    if text.startswith("$"):
        at = 1
    elif m := _BARE.match(text):
        steps.append(m.group())
        at = m.end()
    while at < len(text):
        m = _STEP.match(text, at)
        if not m:
            raise TransformError(f"JSON path {path!r} isn't supported from {text[at:]!r}")
        name, index, *quoted = m.groups()
        steps.append(int(index) if index is not None else name if name is not None else next(re.sub(r"\\(.)", r"\1", q) for q in quoted if q is not None))
        at = m.end()
    return tuple(steps)


class _Huge(float):
    """An integer beyond 64 bits, which counts as a float."""


def _integer(text: str) -> int | float:
    value = int(text)
    return value if -(1 << 63) <= value < 1 << 64 else float(text)


def _refuse(text: str):
    raise ValueError(f"{text} is no JSON")


def parse(document: str):
    try:
        return json.loads(document, parse_int=_integer, parse_constant=_refuse)
    except (ValueError, RecursionError) as e:
        raise TransformError(f"malformed JSON: {document[:200]!r}: {e}") from None


def _number(x: float) -> str:
    text = repr(x)
    if "e" in text:
        mantissa, power = text.split("e")
        text = f"{mantissa}e{int(power)}"
    return text


def to_text(value) -> str:
    """Compact, with sorted keys."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{to_text(v)}" for k, v in sorted(value.items())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(to_text, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def at_path(value, path: str):
    for step in path_steps(path):
        if isinstance(step, int):
            if not isinstance(value, list) or step >= len(value):
                return _MISSING
            value = value[step]
        else:
            if not isinstance(value, dict) or step not in value:
                return _MISSING
            value = value[step]
    return value


# ---- over parsed documents ----


def _extract(value, path: str) -> str | None:
    value = at_path(value, path)
    return None if value is _MISSING or value is None else to_text(value)


def _scalar(value, path: str) -> str | None:
    value = at_path(value, path)
    if value is _MISSING or value is None or isinstance(value, (dict, list)):
        return None
    return value if isinstance(value, str) else to_text(value)


def _size(value, path: str = "$") -> int | None:
    value = at_path(value, path)
    return None if value is _MISSING else len(value) if isinstance(value, (dict, list)) else 0


def _exists(value, path: str) -> bool:
    return at_path(value, path) is not _MISSING


def _array_length(value) -> int | None:
    return len(value) if isinstance(value, list) else None


def _same(a, b) -> bool:
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return isinstance(a, float) == isinstance(b, float) and a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_same(a[k], b[k]) for k in a)
    return type(a) is type(b) and a == b


@functools.lru_cache(256)
def _needle(text: str):
    try:
        return parse(text)
    except TransformError:
        return text


def _array_contains(value, needle: str) -> bool | None:
    return any(_same(v, _needle(needle)) for v in value) if isinstance(value, list) else None


def _array_get(value, index: str) -> str | None:
    try:
        found = value[int(index)] if isinstance(value, list) else None
    except (ValueError, IndexError):
        return None
    return None if found is None else to_text(found)


def _is_scalar(value) -> bool:
    return not isinstance(value, (dict, list))


def _array_elements(value) -> list[str | None] | None:
    return [None if v is None else to_text(v) for v in value] if isinstance(value, list) else None


def _over_text(function: Callable) -> Callable:
    return lambda document, *more: function(parse(document), *more)


extract, scalar, size, exists, array_length, array_contains, array_get, is_scalar, array_elements = map(_over_text, (_extract, _scalar, _size, _exists, _array_length, _array_contains, _array_get, _is_scalar, _array_elements))


def checked(document: str) -> str:
    parse(document)
    return document


#: Name in SQL -> (function of the parsed document and more arguments, result type); no function: the document as it is, once parsed. The names by which Spark has other functions are taken over by rewriting calls.
FUNCTIONS: dict[str, tuple[Callable | None, T.DataType]] = {
    **dict.fromkeys(("json_extract", "json_query"), (_extract, T.StringType())),
    **dict.fromkeys(("json_extract_scalar", "json_value", "json_extract_string", "get_json_object"), (_scalar, T.StringType())),
    "json_size": (_size, T.LongType()),
    "json_exists": (_exists, T.BooleanType()),
    "json_array_length": (_array_length, T.LongType()),
    "json_array_contains": (_array_contains, T.BooleanType()),
    "json_array_get": (_array_get, T.StringType()),
    **dict.fromkeys(("json_parse", "json_format"), (None, T.StringType())),
    "is_json_scalar": (_is_scalar, T.BooleanType()),
    "json_array_elements": (_array_elements, T.ArrayType(T.StringType())),
}


def internal(name: str) -> str:
    return f"mr_{name}"


#: The last columns of documents and what they hold; a column that is kept can't give its memory to another.
_PARSED: list[tuple[pa.Array, list]] = []


def _parsed(documents: pa.Array) -> list:
    """The values of a column of documents, None for null ones (JSON's null is _NULL)."""
    def place(a: pa.Array) -> tuple:
        return (len(a), a.offset, *(b.address if b is not None else 0 for b in a.buffers()))

    at = place(documents)
    for column, values in _PARSED:
        if place(column) == at:
            return values
    values = [None if d is None else _NULL if (v := parse(d)) is None else v for d in documents.to_pylist()]
    _PARSED[:] = [*_PARSED[-1:], (documents, values)]
    return values


_NULL = object()


def _columns(function: Callable | None, kind: pa.DataType) -> Callable:
    def run(*columns: pa.Array) -> pa.Array:
        values = _parsed(columns[0])
        if function is None:
            return columns[0]
        more = [c.to_pylist() for c in columns[1:]]
        if any(c.null_count for c in columns[1:]):
            values = [None if any(m[i] is None for m in more) else v for i, v in enumerate(values)]
        if len(more) == 1:
            made = [None if v is None else function(None if v is _NULL else v, m) for v, m in zip(values, more[0])]
        else:
            made = [None if v is None else function(None if v is _NULL else v, *m) for v, *m in zip(values, *more)]
        return pa.array(made, kind)

    return run


def register(spark: SparkSession) -> None:
    """All functions, under their internal names, in this session."""
    for name, (function, kind) in FUNCTIONS.items():
        spark.udf.register(internal(name), F.arrow_udf(_columns(function, to_arrow_type(kind)), kind))
