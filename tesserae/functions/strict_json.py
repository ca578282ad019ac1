"""Strict JSON that keeps the text of numbers, within limits; output has sorted keys and no spaces."""

from __future__ import annotations

import json
from decimal import Decimal, InvalidOperation

from tesserae.errors import InvalidJson

# The limits on metadata documents.
MAX_BYTES, MAX_DEPTH, MAX_STRING, MAX_ITEMS, MAX_FIELDS = 16 << 20, 128, 4 << 20, 1_000_000, 100_000


class Number(str):
    """A number as it was written."""

    def whole(self) -> int | None:
        """Its value where that is a whole number."""
        try:
            d = Decimal(self)
            return int(d) if d.adjusted() < 400 and d == d.to_integral_value() else None
        except (InvalidOperation, ValueError):
            return None


def loads(text: str | bytes):
    """Parse; duplicate keys, NaN, lone surrogates and documents beyond the limits are errors."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    if len(raw) > MAX_BYTES:
        raise InvalidJson(f"document of {len(raw)} bytes exceeds {MAX_BYTES}")

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise InvalidJson("duplicate key")
        if len(out) > MAX_FIELDS:
            raise InvalidJson(f"object of {len(out)} fields exceeds {MAX_FIELDS}")
        return out

    def constant(name):
        raise InvalidJson(f"{name} is not JSON")

    try:
        value = json.loads(raw.decode("utf-8"), object_pairs_hook=pairs, parse_int=Number, parse_float=Number, parse_constant=constant)
    except InvalidJson:
        raise
    except (ValueError, RecursionError) as e:
        raise InvalidJson(str(e)) from None
    _check(value)
    return value


def _check(value) -> None:
    todo = [(value, 1)]
    while todo:
        v, depth = todo.pop()
        if depth > MAX_DEPTH + 1:
            raise InvalidJson(f"depth exceeds {MAX_DEPTH}")
        if isinstance(v, dict):
            todo += [(x, depth + 1) for kv in v.items() for x in kv]
        elif isinstance(v, list):
            if len(v) > MAX_ITEMS:
                raise InvalidJson(f"array of {len(v)} items exceeds {MAX_ITEMS}")
            todo += [(x, depth + 1) for x in v]
        elif isinstance(v, str):
            if len(v) > MAX_STRING:
                raise InvalidJson(f"string of {len(v)} characters exceeds {MAX_STRING}")
            if any(0xD800 <= ord(c) < 0xE000 for c in v if c > "퟿"):
                raise InvalidJson("lone surrogate")


def dumps(value) -> str:
    """The canonical text of a value."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dumps(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(dumps, value)) + "]"
    return json.dumps(value, ensure_ascii=False, allow_nan=False)


def whole(value, what: str, least: int = 0) -> int:
    n = value.whole() if isinstance(value, Number) else value if isinstance(value, int) and not isinstance(value, bool) else None
    if n is None or n < least:
        raise InvalidJson(f"{what} is not a whole number from {least}: {value!r}")
    return n
