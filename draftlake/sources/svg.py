"""Annotated drawings (SVG) as rows: one per element, failures as rows of their own."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.functions import geometry
from draftlake.functions.text import LAYER_NAMES
from draftlake.functions.vectors import GEOMETRY_TYPES

# The label of a semantic id, and of a layer without one.
SEMANTIC_LABELS = (
    "background wall railing window sliding_door double_door single_door opening_symbol stair blind_window bay_window column beam gas_stove bed sofa chair table wardrobe "
    "washing_machine refrigerator TV_cabinet half_height_cabinet bath_tub toilet sink squat_toilet urinal elevator escalator parking"
).split()
LAYER_LABELS = {
    "WALL": "wall", "WINDOW": "window", "COLUMN": "column", "DOOR": "single_door", "STAIR": "stair", "AXIS": "axis", "DOTE": "axis", "DIM_LEAD": "dimension",
    "PUB_DIM": "dimension", "PUB_HATCH": "hatch", "PUB_TEXT": "room_text", "WINDOW_TEXT": "window_text",
}
INKSCAPE = "{http://www.inkscape.org/namespaces/inkscape}label"
NOT_ATTRIBUTES = ("d", "semantic-id", "instance-id")

_POINT = "array<double>"
SCHEMA = (
    "path string, status string, error string, plan_id string, filename string, viewbox array<double>, pos int, id string, layer string, semantic_id int, instance_id int, semantic_label string, "
    f"geometry_type string, content string, segments array<struct<type:string,start:{_POINT},end:{_POINT},length:double,extra:struct<rx:double,ry:double,x_rotation:double,large_arc:double,sweep:double>>>, "
    f"start {_POINT}, end {_POINT}, length double, center {_POINT}, bbox {_POINT}, geometry_type_onehot array<int>, radius double, rx double, ry double, raw_attributes map<string,string>"
)


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def layer_of(group: ET.Element, translations: dict[str, str]) -> str:
    raw = group.get(INKSCAPE) or group.get("inkscape:label") or group.get("id") or ""
    if not raw:
        return ""
    known = LAYER_NAMES | translations
    if raw in known:
        return known[raw]
    return raw if any("一" <= c <= "鿿" for c in raw) else raw.upper().replace(" ", "_")


def _box(root: ET.Element) -> list[float]:
    try:
        parts = [float(x) for x in root.get("viewBox", "").replace(",", " ").split()]
    except ValueError:
        parts = []
    return parts if len(parts) == 4 else [0.0, 0.0, 100.0, 100.0]


def _int(text: str | None) -> int:
    try:
        return int(text) if text is not None else -1
    except ValueError:
        return -1


def _number(element: ET.Element, name: str, default: float | None) -> float | None:
    """The attribute as a number; ``default`` where it is absent, None where it is no number and there's no default."""
    text = element.get(name)
    try:
        return float(text) if text is not None else 0.0
    except ValueError:
        return default


def _shape(kind: str, e: ET.Element, compat: bool) -> dict | None:
    """Geometry of one element in drawing units, None if there is nothing to draw."""
    if kind == "path":
        segments = geometry.path_segments(e.get("d", ""), compat)
        if not segments:
            return None
        return {
            "geometry_type": geometry.dominant_type(segments), "bounds": geometry.bounds(segments), "start": segments[0].start, "end": segments[-1].end,
            "length": sum(s.length for s in segments),
            "segments": [{"type": s.type, "start": list(s.start), "end": list(s.end), "length": s.length, "extra": s.extra} for s in segments],
        }
    if kind in ("circle", "ellipse"):
        radii = ("r", "r") if kind == "circle" else ("rx", "ry")
        cx, cy, rx, ry = (_number(e, n, None) for n in ("cx", "cy", *radii))
        if None in (cx, cy, rx, ry):
            return None
        if kind == "circle":
            length = 2 * math.pi * rx
        else:
            h = ((rx - ry) / (rx + ry)) ** 2 if rx + ry > 0 else 0.0
            length = math.pi * (rx + ry) * (1 + 3 * h / (10 + math.sqrt(4 - 3 * h)))
        sizes = {"radius": rx} if kind == "circle" else {"rx": rx, "ry": ry}
        return {"geometry_type": kind, "bounds": (cx - rx, cy - ry, cx + rx, cy + ry), "start": (cx - rx, cy), "end": (cx + rx, cy), "length": length, "segments": [], **sizes}
    content = "".join(e.itertext()).strip()
    if not content:
        return None
    x, y = _number(e, "x", 0.0), _number(e, "y", 0.0)
    return {"geometry_type": "text", "bounds": (x, y, x, y), "start": (x, y), "end": (x, y), "length": 0.0, "segments": [], "content": content}


def parse_svg(data: bytes, translations: dict[str, str] | None = None, compat: bool = False) -> tuple[list[float], list[dict]]:
    """View box and element rows of one drawing, in the order group, kind of element, element.

    All endpoints are relative to the view box; ``compat`` leaves those of paths in
    drawing units, as older exports have them.
    """
    root = ET.fromstring(data)
    box = _box(root)
    nx = lambda x: (x - box[0]) / box[2] if box[2] else x
    ny = lambda y: (y - box[1]) / box[3] if box[3] else y
    rows: list[dict] = []
    for group in (g for g in root.iter() if _local(g.tag) == "g" and g is not root):
        layer = layer_of(group, translations or {})
        if not layer:
            continue
        children = list(group)
        for kind in ("path", "circle", "ellipse", "text"):
            for e in (c for c in children if _local(c.tag) == kind):
                shape = _shape(kind, e, compat)
                if shape is None:
                    continue
                x0, y0, x1, y1 = shape.pop("bounds")
                raw_ends = compat and kind == "path"
                ends = {k: list(shape[k]) if raw_ends else [nx(shape[k][0]), ny(shape[k][1])] for k in ("start", "end")}
                semantic = _int(e.get("semantic-id"))
                hot = GEOMETRY_TYPES.index(shape["geometry_type"]) if shape["geometry_type"] in GEOMETRY_TYPES else len(GEOMETRY_TYPES) - 1
                rows.append(
                    shape | ends | {
                        "pos": len(rows) + 1, "id": f"n{len(rows) + 1:05d}", "layer": layer, "semantic_id": semantic, "instance_id": _int(e.get("instance-id")),
                        "semantic_label": SEMANTIC_LABELS[semantic] if 0 <= semantic < len(SEMANTIC_LABELS) else LAYER_LABELS.get(layer, layer.lower()),
                        "length": round(shape["length"], 6),
                        "center": [round(nx((x0 + x1) / 2), 6), round(ny((y0 + y1) / 2), 6)],
                        "bbox": [round(nx(x0), 6), round(ny(y0), 6), round(nx(x1), 6), round(ny(y1), 6)],
                        "geometry_type_onehot": [int(i == hot) for i in range(len(GEOMETRY_TYPES))],
                        "raw_attributes": {k: v for k, v in e.attrib.items() if kind == "text" or k not in NOT_ATTRIBUTES},
                    }
                )
    return box, rows


def read_svg(spark: SparkSession, folder: str, limit: int | None = None, translations: dict[str, str] | None = None, compat: bool = False) -> DataFrame:
    """One row per element of every ``*.svg`` of a folder; a file that can't be read is one row with status ``failed``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.svg").load(folder).select("path", "content")
    if limit is not None:
        files = files.orderBy("path").limit(limit)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                name = path.rpartition("/")[2]
                base = {"path": path, "status": "success", "plan_id": name.removesuffix(".svg"), "filename": name}
                try:
                    box, rows = parse_svg(content, translations, compat)
                    out = [base | {"viewbox": box} | r for r in rows] or [base | {"viewbox": box}]
                except Exception as e:  # noqa: BLE001
                    out = [base | {"status": "failed", "error": f"{type(e).__name__}: {e}"[:300]}]
                frame = pd.DataFrame(out, columns=columns).astype(object)
                yield frame.where(frame.notna(), None)

    return files.mapInPandas(run, SCHEMA)


def run_counters(elements: DataFrame) -> DataFrame:
    """n_files, n_success, n_failed."""
    files = elements.select("path", "status").distinct()
    return files.agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.col("status") == "failed").alias("n_failed"))
