"""Canonical JSON and content identities."""

from __future__ import annotations

import hashlib
import json
import math
import struct


def number(x: float | int) -> str:
    """A number as ECMAScript writes it; integers must be exact as doubles."""
    if isinstance(x, int):
        if abs(x) >= 1 << 53:
            raise ValueError("an integer beyond 2^53")
        return str(x)
    if not math.isfinite(x):
        raise ValueError("not a finite number")
    if x == 0:
        return "0"
    sign, digits = ("-", repr(-x)) if x < 0 else ("", repr(x))
    mantissa, _, exponent = digits.partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) if whole != "0" else int(exponent or 0) - (len(fraction) - len(fraction.lstrip("0")))
    digits = digits.rstrip("0")
    if len(digits) <= point <= 21:
        return sign + digits + "0" * (point - len(digits))
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    power = f"e{'+' if point > 0 else '-'}{abs(point - 1)}"
    return sign + digits[0] + (f".{digits[1:]}" if len(digits) > 1 else "") + power


def dumps(x) -> str:
    """Keys by UTF-16 code units, no spaces, shortest escapes."""
    if x is None or isinstance(x, bool):
        return {None: "null", True: "true", False: "false"}[x]
    if isinstance(x, (int, float)):
        return number(x)
    if isinstance(x, str):
        return json.dumps(x, ensure_ascii=False)
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(dumps, x)) + "]"
    items = sorted(x.items(), key=lambda kv: kv[0].encode("utf-16-be", "surrogatepass"))
    return "{" + ",".join(f"{dumps(k)}:{dumps(v)}" for k, v in items) + "}"


def loads(text: str):
    """JSON without repeated keys, NaN or infinities."""

    def unique(pairs):
        found = dict(pairs)
        if len(found) < len(pairs):
            raise ValueError("a key twice")
        return found

    def refuse(name):
        raise ValueError(f"{name} is no JSON")

    return json.loads(text, object_pairs_hook=unique, parse_constant=refuse)


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def identity(x) -> str:
    return digest(dumps(x).encode())


def result_hash(seeds: list[tuple[int, list[float], float]]) -> str:
    """Over (seed, values, distance), little-endian."""
    return digest(b"".join(struct.pack(f"<Q{len(v)}dd", s, *(x + 0.0 for x in v), d + 0.0) for s, v, d in seeds))
