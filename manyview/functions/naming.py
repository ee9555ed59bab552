"""Names, numbers, ranges and patterns."""

from __future__ import annotations

import fnmatch
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def stem(name: Column | str) -> Column:
    """File name without directories and without its last extension."""
    c = F.col(name) if isinstance(name, str) else name
    base = F.regexp_replace(c, r"^.*[/\\]", "")
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def file_number(name: Column | str) -> Column:
    """The file's number or NULL; ``(n)`` wins over trailing digits."""
    s = stem(name)
    digits = F.coalesce(
        F.nullif(F.regexp_extract(s, r"\((\d+)\)$", 1), F.lit("")),
        F.nullif(F.regexp_extract(s, r"(\d+)$", 1), F.lit("")),
    )
    return digits.cast("long")


def range_parts(expr: str) -> list[tuple[int, int, int]]:
    """``1-10,12,20-30:2`` as inclusive (lo, hi, step) triples."""
    parts = []
    for piece in expr.split(","):
        m = re.fullmatch(r"\s*(-?\d+)(?:\s*-\s*(-?\d+)(?:\s*:\s*(\d+))?)?\s*", piece)
        if not m:
            raise ValueError(f"bad range piece: {piece!r}")
        lo = int(m.group(1))
        hi = int(m.group(2)) if m.group(2) is not None else lo
        step = int(m.group(3)) if m.group(3) is not None else 1
        if hi < lo or step < 1:
            raise ValueError(f"bad range piece: {piece!r}")
        parts.append((lo, hi, step))
    return parts


def in_range(value: Column, expr: str) -> Column:
    """True when the number lies in the range expression; no list is materialised."""
    test = F.lit(False)
    for lo, hi, step in range_parts(expr):
        test = test | (value.between(lo, hi) & ((value - lo) % step == 0))
    return F.coalesce(test, F.lit(False))


def range_values(spark: SparkSession, expr: str) -> DataFrame:
    """The distinct numbers of a range expression, ascending."""
    pieces = [spark.range(lo, hi + 1, step) for lo, hi, step in range_parts(expr)]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.union(p)
    return out.select(F.col("id").alias("number")).distinct().orderBy("number")


def glob_match(name: Column | str, pattern: str) -> Column:
    """Shell-style match of the whole name."""
    c = F.col(name) if isinstance(name, str) else name
    regex = "".join(_glob_pieces(pattern))
    return c.rlike(f"(?s)^{regex}$")


def _glob_pieces(pattern: str):
    for token in re.findall(r"\[!?\]?[^\]]*\]|.", pattern, flags=re.S):
        if token == "*":
            yield ".*"
        elif token == "?":
            yield "."
        elif len(token) > 2 and token[0] == "[" and token[-1] == "]":
            body = token[1:-1].replace("\\", "\\\\")
            yield f"[^{body[1:]}]" if body.startswith("!") else f"[{body}]"
        else:
            yield re.escape(token)


def glob_selects(name: str, pattern: str) -> bool:
    """The same test for one plain string, used for driver-side arguments."""
    return fnmatch.fnmatchcase(name, pattern)


def normalise_path(name: Column | str) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.replace(c, F.lit("\\"), F.lit("/"))


# Angle units in radians per unit.
RADIANS_PER_UNIT = {"deg": 3.141592653589793 / 180.0, "rad": 1.0}

# Length units in metres per unit.
METRES_PER_UNIT = {
    "nm": 1e-9, "um": 1e-6, "mm": 1e-3, "cm": 1e-2, "m": 1.0, "km": 1e3,
    "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344,
}


def quantity(text: Column | str, units: dict[str, float], default_unit: str | None = None) -> Column:
    """``'12.5cm'`` style text to a number in base units (NULL when malformed)."""
    c = F.trim(F.col(text) if isinstance(text, str) else text)
    shape = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)\s*([A-Za-z]*)$"
    number = F.regexp_extract(c, shape, 1)
    unit = F.lower(F.regexp_extract(c, shape, 2))
    factor = F.lit(None).cast("double")
    for u, f in units.items():
        factor = F.when(unit == u, F.lit(float(f))).otherwise(factor)
    if default_unit is not None:
        factor = F.when(unit == "", F.lit(float(units[default_unit]))).otherwise(factor)
    return F.when(number != "", number.cast("double") * factor)


def frame_pattern(pattern: str) -> str:
    """Regex of a rig image pattern whose ``%d`` / ``%0Nd`` field captures the frame number."""
    out = []
    fields = 0
    for token in re.findall(r"%0?\d*d|%%|.", pattern, flags=re.S):
        if token == "%%":
            out.append("%")
        elif token.startswith("%"):
            fields += 1
            width = token[1:-1]
            out.append(f"(\\d{{{int(width)},}})" if width.startswith("0") and int(width or 0) > 0 else "(\\d+)")
        else:
            out.append(re.escape(token))
    if fields != 1:
        raise ValueError("a rig image pattern needs exactly one frame field")
    return "^" + "".join(out) + "$"


def frame_number(path: Column | str, pattern: str) -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.nullif(F.regexp_extract(normalise_path(c), frame_pattern(pattern), 1), F.lit("")).cast("long")


def frame_key(path: Column | str, prefix: str) -> Column:
    """Path with the sensor prefix removed: equal keys belong to one rig frame."""
    c = F.col(path) if isinstance(path, str) else path
    return F.when(F.startswith(c, F.lit(prefix)), F.substr(c, F.lit(len(prefix) + 1)))
