"""Well-known text and binary, and GeoJSON geometries, without other libraries.

A geometry is a pair (type, coordinates) with GeoJSON's type names and nested tuples; a collection's
coordinates are its members.  Extra ordinates (Z, M) are read and dropped.  Malformed text, empty
geometries, non-finite numbers and nesting deeper than 32 raise ValueError.
"""

from __future__ import annotations

import json
import math
import re
import struct

MAX_DEPTH = 32
# Geometry types by their binary code, and the depth of their coordinates.
TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {name: code for code, name in TYPES.items()}
LEVELS = {"Point": 0, "LineString": 1, "Polygon": 2, "MultiPoint": 1, "MultiLineString": 2, "MultiPolygon": 3}
_TOKEN = re.compile(r"\s*([A-Za-z]+|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?|[(),;=])")

Geometry = tuple


def _number(text: str) -> float:
    v = float(text)
    if not math.isfinite(v):
        raise ValueError(f"{text} isn't finite")
    return v


def from_wkt(text: str) -> Geometry:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected text at {at}: {text[at : at + 20]!r}")
        tokens.append(m[1])
        at = m.end()
    tokens.reverse()
    if tokens and tokens[-1].upper() == "SRID":
        for expected in ("SRID", "=", None, ";"):
            got = tokens.pop() if tokens else ""
            if expected and got.upper() != expected:
                raise ValueError("malformed SRID")
    geometry = _wkt_geometry(tokens, 0)
    if tokens:
        raise ValueError(f"trailing text: {tokens[-1]!r}")
    return geometry


def _take(tokens: list[str], expected: str) -> None:
    if not tokens or tokens.pop() != expected:
        raise ValueError(f"expected {expected!r}")


def _wkt_geometry(tokens: list[str], depth: int) -> Geometry:
    if depth > MAX_DEPTH or not tokens:
        raise ValueError("too deep or cut short")
    name = tokens.pop().upper()
    for tag in ("ZM", "Z", "M"):
        if name.endswith(tag) and name.removesuffix(tag) in {k.upper() for k in CODES}:
            name = name.removesuffix(tag)
            break
    else:
        if tokens and tokens[-1].upper() in ("Z", "M", "ZM"):
            tokens.pop()
    kind = next((k for k in CODES if k.upper() == name), None)
    if kind is None or (tokens and tokens[-1].upper() == "EMPTY"):
        raise ValueError(f"unknown or empty geometry {name!r}")
    if kind == "GeometryCollection":
        return kind, _wkt_list(tokens, lambda: _wkt_geometry(tokens, depth + 1))
    if kind == "Point":
        _take(tokens, "(")
        point = _wkt_point(tokens)
        _take(tokens, ")")
        return kind, point
    return kind, _wkt_nested(tokens, LEVELS[kind], kind == "MultiPoint")


def _wkt_list(tokens: list[str], item) -> tuple:
    _take(tokens, "(")
    out = [item()]
    while tokens and tokens[-1] == ",":
        tokens.pop()
        out.append(item())
    _take(tokens, ")")
    return tuple(out)


def _wkt_nested(tokens: list[str], level: int, loose: bool) -> tuple:
    if level > 1:
        return _wkt_list(tokens, lambda: _wkt_nested(tokens, level - 1, loose))

    def item() -> tuple:
        if loose and tokens and tokens[-1] == "(":  # both spellings of a multipoint
            tokens.pop()
            point = _wkt_point(tokens)
            _take(tokens, ")")
            return point
        return _wkt_point(tokens)

    return _wkt_list(tokens, item)


def _wkt_point(tokens: list[str]) -> tuple[float, float]:
    values = []
    while tokens and tokens[-1] not in "(),":
        values.append(_number(tokens.pop()))
    if not 2 <= len(values) <= 4:
        raise ValueError("a position has two to four numbers")
    return values[0], values[1]


def _plain(v: float) -> str:
    return str(int(v)) if v == int(v) and abs(v) < 1e15 else repr(v)


def to_wkt(g: Geometry) -> str:
    kind, c = g
    if kind == "GeometryCollection":
        return f"GEOMETRYCOLLECTION ({', '.join(map(to_wkt, c))})"

    def render(x: tuple, level: int) -> str:
        return f"{_plain(x[0])} {_plain(x[1])}" if not level else "(" + ", ".join(render(y, level - 1) for y in x) + ")"

    body = render(c, LEVELS[kind])
    return f"{kind.upper()} {body if LEVELS[kind] else f'({body})'}"


def from_wkb(raw: bytes) -> Geometry:
    geometry, end = _wkb_geometry(raw, 0, 0)
    if end != len(raw):
        raise ValueError("trailing bytes")
    return geometry


def decode_type_code(code: int) -> tuple[int, int, bool]:
    """(geometry code, extra ordinates, whether an SRID follows), of ISO and extended codes."""
    extra = bool(code & 0x80000000) + bool(code & 0x40000000)
    srid, low = bool(code & 0x20000000), code & 0x0FFFFFFF
    return low % 1000, extra or {0: 0, 1: 1, 2: 1, 3: 2}.get(low // 1000, 0), srid


def _wkb_geometry(raw: bytes, at: int, depth: int) -> tuple[Geometry, int]:
    if depth > MAX_DEPTH or at + 5 > len(raw) or raw[at] > 1:
        raise ValueError("too deep, cut short or of unknown byte order")
    order = "<" if raw[at] else ">"
    code, extra, srid = decode_type_code(struct.unpack_from(order + "I", raw, at + 1)[0])
    kind = TYPES.get(code)
    if kind is None:
        raise ValueError(f"unknown geometry code {code}")
    at += 9 if srid else 5
    size = 8 * (2 + extra)

    def count(at: int) -> tuple[int, int]:
        if at + 4 > len(raw):
            raise ValueError("cut short")
        n = struct.unpack_from(order + "I", raw, at)[0]
        if n > len(raw):
            raise ValueError("a count is larger than the data")
        return n, at + 4

    def position(at: int) -> tuple[tuple[float, float], int]:
        if at + size > len(raw):
            raise ValueError("cut short")
        x, y = struct.unpack_from(order + "dd", raw, at)
        if not (math.isfinite(x) and math.isfinite(y)):
            raise ValueError("a coordinate isn't finite")
        return (x, y), at + size

    def several(at: int, item) -> tuple[tuple, int]:
        n, at = count(at)
        out = []
        for _ in range(n):
            value, at = item(at)
            out.append(value)
        return tuple(out), at

    if kind == "Point":
        point, at = position(at)
        return (kind, point), at
    if kind == "LineString":
        c, at = several(at, position)
    elif kind == "Polygon":
        c, at = several(at, lambda a: several(a, position))
    else:
        c, at = several(at, lambda a: _wkb_geometry(raw, a, depth + 2))
        if kind != "GeometryCollection":
            if any(m[0] != kind.removeprefix("Multi") for m in c):
                raise ValueError("a member is of another type")
            c = tuple(m[1] for m in c)
    return (kind, c), at


def to_wkb(g: Geometry) -> bytes:
    """Little-endian."""
    kind, c = g
    out = struct.pack("<BI", 1, CODES[kind])

    def line(points: tuple) -> bytes:
        return struct.pack("<I", len(points)) + b"".join(struct.pack("<dd", *p) for p in points)

    if kind == "Point":
        return out + struct.pack("<dd", *c)
    if kind == "LineString":
        return out + line(c)
    if kind == "Polygon":
        return out + struct.pack("<I", len(c)) + b"".join(map(line, c))
    members = c if kind == "GeometryCollection" else [(kind.removeprefix("Multi"), m) for m in c]
    return out + struct.pack("<I", len(members)) + b"".join(map(to_wkb, members))


def from_geojson(value: str | dict, depth: int = 0) -> Geometry:
    value = json.loads(value) if isinstance(value, str) else value
    if depth > MAX_DEPTH or not isinstance(value, dict) or value.get("type") not in CODES:
        raise ValueError("not a geometry")
    kind = value["type"]
    if kind == "GeometryCollection":
        return kind, tuple(from_geojson(m, depth + 1) for m in value["geometries"])

    def nested(c: list, level: int) -> tuple:
        if level:
            return tuple(nested(x, level - 1) for x in c)
        if len(c) < 2 or not all(isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v) for v in c[:2]):
            raise ValueError("a position needs two finite numbers")
        return float(c[0]), float(c[1])

    if not isinstance(value.get("coordinates"), list):
        raise ValueError("no coordinates")
    return kind, nested(value["coordinates"], LEVELS[kind])


def to_geojson(g: Geometry) -> str:
    def value(g: Geometry) -> dict:
        if g[0] == "GeometryCollection":
            return {"geometries": [value(m) for m in g[1]], "type": g[0]}
        return {"coordinates": g[1], "type": g[0]}

    return json.dumps(value(g), separators=(",", ":"))


def positions(g: Geometry) -> list[tuple[float, float]]:
    """All coordinates of any geometry."""
    if g[0] == "GeometryCollection":
        return [p for m in g[1] for p in positions(m)]

    def flat(c: tuple, level: int) -> list:
        return [c] if not level else [p for x in c for p in flat(x, level - 1)]

    return flat(g[1], LEVELS[g[0]])
