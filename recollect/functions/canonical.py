"""Canonical JSON and digests. Driver code for bounded values, an Arrow UDF for columns."""

from __future__ import annotations

import hashlib
import json
import math
import re
import unicodedata
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_SAFE = 2**53 - 1
MAX_DATA_BYTES = 8 << 20
RESERVED = ("__proto__", "constructor", "prototype")


class EncodingError(ValueError):
    """The value has no canonical form."""


def _check(value: Any, depth: int) -> Any:
    if depth < 0:
        raise EncodingError("too deep")
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, str):
        if any("\ud800" <= c <= "\udfff" for c in value):
            raise EncodingError("lone surrogate")
        return value
    if isinstance(value, (int, float)):
        if isinstance(value, float) and (not math.isfinite(value) or (value == 0 and math.copysign(1, value) < 0)):
            raise EncodingError("number without a form")
        whole = float(value).is_integer()
        if not whole or abs(value) > MAX_SAFE:
            raise EncodingError("only safe whole numbers have a canonical form")
        return int(value)
    if isinstance(value, (list, tuple)):
        return [_check(v, depth - 1) for v in value]
    if isinstance(value, dict):
        if any(k in RESERVED for k in value):
            raise EncodingError("reserved key")
        return {k: _check(value[k], depth - 1) for k in sorted(value, key=lambda k: k.encode("utf-16-be"))}
    raise EncodingError(f"no form for {type(value).__name__}")


def canonical_json(value: Any, limit: int | None = None, depth: int = 16) -> bytes:
    """UTF-8 of ``value`` with keys in UTF-16 order and no spaces; ``EncodingError`` where there is none or it passes ``limit``."""
    data = json.dumps(_check(value, depth), ensure_ascii=False, separators=(",", ":")).encode()
    if limit is not None and len(data) > limit:
        raise EncodingError("too long")
    return data


def number_text(x: float) -> str:
    """The shortest decimal text of a finite double: plain between 1e-6 and 1e21, else with an exponent; both zeros are 0."""
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    whole = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent
    if 0 < point <= 21:
        body = whole.ljust(point, "0") if len(whole) <= point else f"{whole[:point]}.{whole[point:]}"
    elif -6 < point <= 0:
        body = f"0.{'0' * -point}{whole}"
    else:
        body = f"{whole[0]}{'.' if whole[1:] else ''}{whole[1:]}e{point - 1:+d}"
    return "-" * sign + body


def data_json(value: Any, limit: int = MAX_DATA_BYTES) -> bytes:
    """UTF-8 of any JSON value of at most ``limit`` bytes: keys in UTF-16 order, numbers as doubles, lone surrogates escaped.

    Wider than ``canonical_json``. The walk keeps its own stack, so depth is bounded by size alone; what is no JSON, a cycle
    included, is an ``EncodingError``.
    """
    out: list[str] = []
    size, stack, open_now = 0, [(True, value)], set()
    while stack:
        is_value, v = stack.pop()
        if not is_value and not isinstance(v, str):
            open_now.discard(v)
            continue
        if not is_value:
            text = v
        elif v is None or isinstance(v, bool):
            text = json.dumps(v)
        elif isinstance(v, (int, float)):
            try:
                x = float(v)
            except OverflowError as e:
                raise EncodingError("number without a form") from e
            if not math.isfinite(x):
                raise EncodingError("number without a form")
            text = number_text(x)
        elif isinstance(v, str):
            text = re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(v, ensure_ascii=False))
        elif isinstance(v, (list, tuple, dict)):
            if id(v) in open_now or isinstance(v, dict) and any(not isinstance(k, str) for k in v):
                raise EncodingError("no JSON value")
            open_now.add(id(v))
            names = sorted(v, key=lambda k: k.encode("utf-16-be", "surrogatepass")) if isinstance(v, dict) else None
            text, last = ("{", "}") if names is not None else ("[", "]")
            stack += [(False, id(v)), (False, last)]
            items = names if names is not None else range(len(v))
            for at, k in reversed(list(enumerate(items))):
                stack.append((True, v[k]))
                if names is not None:
                    stack += [(False, ":"), (True, k)]
                if at:
                    stack.append((False, ","))
        else:
            raise EncodingError(f"no form for {type(v).__name__}")
        size += len(text.encode())
        if size > limit:
            raise EncodingError("too long")
        out.append(text)
    return "".join(out).encode()


def digest(value: Any, limit: int | None = None) -> str:
    """SHA-256 of the canonical form."""
    return hashlib.sha256(canonical_json(value, limit)).hexdigest()


@F.pandas_udf(T.StringType())
def _canonical(s: pd.Series) -> pd.Series:
    def one(text: str | None) -> str | None:
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"), sort_keys=True)
        except ValueError:
            return None

    return s.map(one)


def canonical_text(c: Column) -> Column:
    """A JSON text with sorted keys and no spaces; null where it is no JSON."""
    return _canonical(c)


def depth_and_size(value: Any) -> tuple[int, int]:
    """Nesting depth of a parsed JSON value and the sum of its strings' lengths, keys included."""
    deepest, size, stack = 0, 0, [(value, 0)]
    while stack:
        v, d = stack.pop()
        deepest = max(deepest, d)
        if isinstance(v, str):
            size += len(v)
        elif isinstance(v, list):
            stack.extend((x, d + 1) for x in v)
        elif isinstance(v, dict):
            size += sum(map(len, v))
            stack.extend((x, d + 1) for x in v.values())
    return deepest, size


def normal(text: str) -> str:
    return unicodedata.normalize("NFC", text)
