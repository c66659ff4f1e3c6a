"""Vector and small numeric rules as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda s, x: s + x * x))


def unit(v: Column) -> Column:
    """v of length one; a zero vector raises, as it has no direction."""
    n = norm(v)
    return F.when(n > 0, F.transform(as_double(v), lambda x: x / n)).otherwise(F.raise_error(F.lit("a zero vector has no direction")).cast("array<double>"))


def one_hot(index: Column, width: int) -> Column:
    """Zeros with a one at index; all zeros out of range."""
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: (i == index).cast("int"))


GEOMETRY_TYPES = ["line", "arc", "curve", "circle", "ellipse", "text", "other"]


def geometry_index(c: Column) -> Column:
    known = F.array_position(F.array(*map(F.lit, GEOMETRY_TYPES)), c)
    return F.coalesce(F.when(known > 0, known - 1), F.lit(len(GEOMETRY_TYPES) - 1)).cast("int")


def safe(c: Column, kind: str, default: object) -> Column:
    return F.coalesce(c.try_cast(kind), F.lit(default).cast(kind))


def at(values: Column, i: int, default: float = 0.0) -> Column:
    return F.coalesce(F.get(values, F.lit(i)), F.lit(default))


def density(n_nodes: Column) -> Column:
    return F.when(n_nodes < 300, F.lit("compact")).when(n_nodes >= 700, F.lit("large")).otherwise(F.lit("moderate"))


def scale_bucket(beds: Column) -> Column:
    """0 none, 1 up to 50, 2 up to 150, 3 beyond."""
    b = F.coalesce(beds, F.lit(0))
    return F.when(b <= 0, 0).when(b <= 50, 1).when(b <= 150, 2).otherwise(3)


def relation(layer_a: Column, layer_b: Column) -> Column:
    wall_window = (layer_a.contains("WALL") & layer_b.contains("WINDOW")) | (layer_a.contains("WINDOW") & layer_b.contains("WALL"))
    return F.when(wall_window, F.lit("wall_window")).when(layer_a == layer_b, F.lit("same_layer_adjacent")).otherwise(F.lit("adjacent"))


def relation_id(c: Column) -> Column:
    return F.when(c == "same_layer_adjacent", 1).when(c == "wall_window", 2).otherwise(0)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((F.get(a, F.lit(0)) - F.get(b, F.lit(0))) ** 2 + (F.get(a, F.lit(1)) - F.get(b, F.lit(1))) ** 2)


def endpoint_distance(a: Column, b: Column) -> Column:
    """Least distance between an endpoint of a and one of b."""
    return F.least(*(distance(a[x], b[y]) for x in ("start", "end") for y in ("start", "end")))


def circumference(r: Column) -> Column:
    return 2 * F.pi() * r


def ellipse_perimeter(rx: Column, ry: Column) -> Column:
    """Ramanujan's second approximation."""
    h = F.when(rx + ry > 0, ((rx - ry) / (rx + ry)) ** 2).otherwise(F.lit(0.0))
    return F.pi() * (rx + ry) * (1 + 3 * h / (10 + F.sqrt(4 - 3 * h)))


def random_order(c: Column, seed: int) -> Column:
    """Key of a shuffle in [0, 2**32): the leading digits of a digest of seed and id, which other SQL engines can compute too."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), c.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def bedrooms(meta: Column) -> Column:
    """Bedrooms that a plan's layout summary states, -1 without one."""
    return F.coalesce(meta["layout_summary"]["bedrooms"], F.lit(-1))


def temperature(logit_scale: Column) -> Column:
    return 1 / F.least(F.exp(logit_scale), F.lit(100.0))
