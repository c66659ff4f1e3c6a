"""Queries of the drawing analytics and retrieval operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from draftlake.common import table
from draftlake.functions import text, vectors
from draftlake.operators import contracts as ct
from draftlake.operators import encoder, graph_encoder, metrics, proximity, sampling, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- contracts -------------------------------------------------------------

C = """WITH c AS (
  SELECT contract_id, arg_max(nodes, ingested_at) AS nodes, arg_max(edges, ingested_at) AS edges, arg_max(metadata, ingested_at) AS metadata
  FROM contracts WHERE _corrupt_record IS NULL GROUP BY contract_id),
n AS (SELECT contract_id, pos - 1 AS pos, x.* FROM (SELECT contract_id, unnest(nodes) AS x, generate_subscripts(nodes, 1) AS pos FROM c)),
e AS (SELECT contract_id, pos - 1 AS pos, x.* FROM (SELECT contract_id, unnest(edges) AS x, generate_subscripts(edges, 1) AS pos FROM c)),
garbage AS (SELECT '(?i)[$]|[#]|\\d{4,}\\s*x\\s|^lf|^p\\d|^a[-_]|^knot[-_]|^0[-_]|^s[-_]|^m[-_]|^dim[-_]|symb|\\[|\\]|^vpipe|^equip[-_]|(?:[^\\s]+[-_]){2,}[^\\s]+' AS re),
l AS (SELECT contract_id, pos, id, CASE WHEN t IN ('', '0', '-1') OR length(t) > 40 OR regexp_matches(t, re) THEN NULL ELSE t END AS label
  FROM (SELECT contract_id, pos, id, regexp_replace(semantic_label, '^\\s+|\\s+$', '', 'g') AS t FROM n), garbage)
"""


def _nodes(s: SparkSession, d: str, *fields: str) -> DataFrame:
    return ct.nodes(table(s, d, "contracts"), *fields)


@query(C + "SELECT contract_id, label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY 1, 2")
def label_inventory(s: SparkSession, d: str) -> DataFrame:
    return ct.label_inventory(_nodes(s, d, "semantic_label"))


@query(C + "SELECT contract_id, count(DISTINCT label) AS n_labels FROM l WHERE label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT label) >= 2")
def low_signal_filter(s: SparkSession, d: str) -> DataFrame:
    return ct.low_signal(ct.label_inventory(_nodes(s, d, "semantic_label")))


@query(
    C
    + """, g AS (SELECT semantic_label AS raw, regexp_replace(semantic_label, '^\\s+|\\s+$', '', 'g') AS t FROM (SELECT DISTINCT semantic_label FROM n))
SELECT raw, length(t) > 40 OR regexp_matches(t, re) AS garbage FROM g, garbage WHERE raw IS NOT NULL"""
)
def garbage_filter(s: SparkSession, d: str) -> DataFrame:
    raw = _nodes(s, d, "semantic_label").select(F.col("semantic_label").alias("raw")).where("raw is not null").distinct()
    return raw.select("raw", text.is_garbage_label(F.regexp_replace("raw", r"^\s+|\s+$", "")).alias("garbage"))


@query(C + "SELECT contract_id, layer, count(*) AS n FROM n GROUP BY 1, 2")
def layer_counts(s: SparkSession, d: str) -> DataFrame:
    return ct.layer_counts(_nodes(s, d, "layer"))


@query(
    C
    + """, m AS (SELECT contract_id, semantic_id, count(*) AS k FROM n WHERE semantic_id >= 0 GROUP BY 1, 2),
r AS (SELECT contract_id, semantic_id, row_number() OVER (PARTITION BY contract_id ORDER BY k DESC, semantic_id) AS rn FROM m)
SELECT a.contract_id, coalesce(r.semantic_id + 1, 0) AS graph_label FROM (SELECT DISTINCT contract_id FROM n) a LEFT JOIN r ON r.contract_id = a.contract_id AND rn = 1"""
)
def mode_label(s: SparkSession, d: str) -> DataFrame:
    return ct.graph_label(_nodes(s, d, "semantic_id"))


@query(
    C
    + """SELECT contract_id, 'sym_' || semantic_id || '_' || instance_id AS symbol_id, semantic_id, instance_id, string_agg(id, ' ' ORDER BY pos) AS node_ids, count(*) AS node_count
FROM n WHERE semantic_id <> -1 AND instance_id <> -1 GROUP BY 1, 3, 4"""
)
def symbol_grouping(s: SparkSession, d: str) -> DataFrame:
    return ct.symbols(_nodes(s, d, "id", "semantic_id", "instance_id")).withColumn("node_ids", F.array_join("node_ids", " ")).withColumn("node_count", F.col("node_count").cast("long"))


@query(
    C
    + """, k AS (SELECT contract_id, id, arg_max(coalesce(label, ''), pos) AS label FROM l GROUP BY 1, 2),
j AS (SELECT e.contract_id, a.label AS x, b.label AS y FROM e JOIN k a ON a.contract_id = e.contract_id AND a.id = e.source JOIN k b ON b.contract_id = e.contract_id AND b.id = e.target)
SELECT DISTINCT contract_id, least(x, y) AS label_a, greatest(x, y) AS label_b, least(x, y) || ' is adjacent to the ' || greatest(x, y) AS sentence
FROM j WHERE x <> y AND x <> '' AND y <> '' AND x NOT IN ('wall', 'window', 'dimension', 'room_text') AND y NOT IN ('wall', 'window', 'dimension', 'room_text')"""
)
def unordered_adjacency(s: SparkSession, d: str) -> DataFrame:
    ends = ct.edge_ends(table(s, d, "contracts"), ("semantic_label",))
    return ct.label_pairs(ends.select("contract_id", F.col("a.semantic_label").alias("a"), F.col("b.semantic_label").alias("b")))


@query(
    C
    + """SELECT contract_id, coalesce(len(nodes), 0) AS n_nodes, CASE WHEN coalesce(len(nodes), 0) < 300 THEN 'compact' WHEN len(nodes) >= 700 THEN 'large' ELSE 'moderate' END AS density FROM c"""
)
def density_bucket(s: SparkSession, d: str) -> DataFrame:
    return ct.density(table(s, d, "contracts")).withColumn("n_nodes", F.col("n_nodes").cast("long"))


@query(
    C
    + """, q AS (SELECT coalesce(len(nodes), 0) AS k, row_number() OVER (ORDER BY coalesce(len(nodes), 0)) - 1 AS i, count(*) OVER () AS t FROM c)
SELECT min(k) AS min_nodes, min(CASE WHEN i = t // 2 THEN k END) AS median_nodes, max(k) AS max_nodes, count(*) AS n_graphs FROM q"""
)
def node_count_stats(s: SparkSession, d: str) -> DataFrame:
    out = ct.node_count_stats(table(s, d, "contracts"))
    return out.select(*(F.col(c).cast("long") for c in out.columns))


@query(
    C
    + """, f AS (SELECT layer AS value, min({'c': contract_id, 'p': pos}) AS first FROM n WHERE layer IS NOT NULL AND layer <> 'UNK' GROUP BY 1)
SELECT value, CAST(row_number() OVER (ORDER BY first.c, first.p, value) AS INT) AS index FROM f UNION ALL SELECT 'UNK', 0"""
)
def vocab_first_seen(s: SparkSession, d: str) -> DataFrame:
    return ct.vocabulary(_nodes(s, d, "layer"), "layer", "UNK")


_G = "coalesce(nullif(list_position(['line', 'arc', 'curve', 'circle', 'ellipse', 'text', 'other'], coalesce(geometry_type, 'other')), 0) - 1, 6)"


@query(
    C
    + f"""SELECT contract_id, pos, coalesce(features.length, 0) AS length, coalesce(features.center[1], 0) AS center_0, coalesce(features.center[2], 0) AS center_1,
coalesce(features.bbox[1], 0) AS bbox_0, coalesce(features.bbox[2], 0) AS bbox_1, coalesce(features.bbox[3], 0) AS bbox_2, coalesce(features.bbox[4], 0) AS bbox_3,
CAST(coalesce(instance_id, -1) <> -1 AS DOUBLE) AS is_instance, CAST(coalesce(semantic_id, -1) AS DOUBLE) AS semantic, CAST({_G} AS INT) AS geometry FROM n"""
)
def feature_vector(s: SparkSession, d: str) -> DataFrame:
    return ct.node_features(_nodes(s, d, "features", "instance_id", "semantic_id", "geometry_type"))


@query(C + f"SELECT contract_id, {', '.join(f'CAST(sum(CASE WHEN {_G} = {i} THEN 1 ELSE 0 END) AS BIGINT) AS g{i}' for i in range(7))} FROM n GROUP BY 1")
def one_hot(s: SparkSession, d: str) -> DataFrame:
    hot = _nodes(s, d, "geometry_type").select("contract_id", vectors.one_hot(vectors.geometry_index(F.coalesce("geometry_type", F.lit("other"))), 7).alias("h"))
    return hot.groupBy("contract_id").agg(*(F.sum(F.get("h", F.lit(i))).cast("long").alias(f"g{i}") for i in range(7)))


@query(
    C
    + """, i AS (SELECT contract_id, id, max(pos) AS node FROM n GROUP BY 1, 2),
b AS (SELECT e.contract_id, e.pos, s.node AS a, t.node AS b, coalesce(distance, 0) AS distance, CASE relation WHEN 'same_layer_adjacent' THEN 1 WHEN 'wall_window' THEN 2 ELSE 0 END AS relation_id
  FROM e JOIN i s ON s.contract_id = e.contract_id AND s.id = e.source JOIN i t ON t.contract_id = e.contract_id AND t.id = e.target)
SELECT contract_id, CAST(sum(distance) AS DOUBLE) AS sum_distance, count(*) AS n_edges, CAST(sum(src * 7 + dst * 13 + relation_id) AS BIGINT) AS checksum FROM (
  SELECT contract_id, a AS src, b AS dst, distance, relation_id FROM b UNION ALL SELECT contract_id, b, a, distance, relation_id FROM b) GROUP BY 1""".replace("CAST(sum(distance) AS DOUBLE)", "round(CAST(sum(distance) AS DOUBLE), 5)")
)
def edge_bidirectional(s: SparkSession, d: str) -> DataFrame:
    ends = ct.edge_ends(table(s, d, "contracts"), (), ("distance", "relation"))
    both = ct.both_ways(ends.select("contract_id", "pos", "edge.distance", "edge.relation", F.col("a.pos").alias("a"), F.col("b.pos").alias("b")))
    return both.groupBy("contract_id").agg(
        F.round(F.sum("distance"), 5).alias("sum_distance"), F.count(F.lit(1)).alias("n_edges"), F.sum(F.col("src") * 7 + F.col("dst") * 13 + F.col("relation_id")).cast("long").alias("checksum")
    )


@query(
    C
    + """, i AS (SELECT contract_id, id, arg_max(coalesce(layer, ''), pos) AS layer FROM n GROUP BY 1, 2)
SELECT e.contract_id, e.pos, CASE WHEN (s.layer LIKE '%WALL%' AND t.layer LIKE '%WINDOW%') OR (s.layer LIKE '%WINDOW%' AND t.layer LIKE '%WALL%') THEN 'wall_window' WHEN s.layer = t.layer THEN 'same_layer_adjacent' ELSE 'adjacent' END AS relation
FROM e JOIN i s ON s.contract_id = e.contract_id AND s.id = e.source JOIN i t ON t.contract_id = e.contract_id AND t.id = e.target"""
)
def edge_relation_type(s: SparkSession, d: str) -> DataFrame:
    ends = ct.edge_ends(table(s, d, "contracts"), ("layer",))
    return ends.select("contract_id", "pos", vectors.relation(F.coalesce("a.layer", F.lit("")), F.coalesce("b.layer", F.lit(""))).alias("relation"))


@query(C + "SELECT contract_id, count(*) AS n FROM n WHERE coalesce(layer, '') NOT IN ('DIM_LEAD', 'PUB_DIM', 'AXIS', 'layerAXIS', 'WINDOW_TEXT', 'PUB_TEXT', 'PUB_HATCH') AND coalesce(geometry_type, '') <> 'text' GROUP BY 1")
def structural_nodes(s: SparkSession, d: str) -> DataFrame:
    return ct.structural(_nodes(s, d, "layer", "geometry_type")).groupBy("contract_id").agg(F.count(F.lit(1)).alias("n"))


_SEG = """, g AS (SELECT contract_id, pos, k, s.* FROM (SELECT contract_id, pos, unnest(segments) AS s, generate_subscripts(segments, 1) AS k FROM n)),
ty AS (SELECT contract_id, pos, type, count(*) AS c, min(k) AS first FROM g GROUP BY 1, 2, 3),
dom AS (SELECT contract_id, pos, type AS dominant_type FROM (SELECT *, row_number() OVER (PARTITION BY contract_id, pos ORDER BY c DESC, first) AS rn FROM ty) WHERE rn = 1),
sz AS (SELECT contract_id, pos, round_even(sum(length), 6) AS total_length, least(min(start[1]), min("end"[1])) AS min_x, least(min(start[2]), min("end"[2])) AS min_y,
  greatest(max(start[1]), max("end"[1])) AS max_x, greatest(max(start[2]), max("end"[2])) AS max_y FROM g GROUP BY 1, 2)
SELECT contract_id, pos, dominant_type, total_length, min_x, min_y, max_x, max_y, round_even((min_x + max_x) / 2, 6) AS center_x, round_even((min_y + max_y) / 2, 6) AS center_y FROM sz JOIN dom USING (contract_id, pos)"""


@query(C + _SEG)
def bbox_center(s: SparkSession, d: str) -> DataFrame:
    return ct.segment_summary(_nodes(s, d, "segments"))


@query(C + _SEG.rpartition("SELECT contract_id, pos, dominant_type, total")[0] + "SELECT dominant_type, count(*) AS n_nodes FROM dom GROUP BY 1")
def dominant_label(s: SparkSession, d: str) -> DataFrame:
    return ct.segment_summary(_nodes(s, d, "segments")).groupBy("dominant_type").agg(F.count(F.lit(1)).alias("n_nodes"))


_D = " least({}) ".format(", ".join(f"sqrt(power(s.p.{a}[1] - t.p.{b}[1], 2) + power(s.p.{a}[2] - t.p.{b}[2], 2))" for a in ('"start"', '"end"') for b in ('"start"', '"end"')))


@query(
    C
    + f""", i AS (SELECT contract_id, id, arg_max({{'p': endpoints}}, pos).p AS p FROM n GROUP BY 1, 2)
SELECT e.contract_id, e.pos, round({_D}, 6) AS distance FROM e JOIN i s ON s.contract_id = e.contract_id AND s.id = e.source JOIN i t ON t.contract_id = e.contract_id AND t.id = e.target WHERE s.p IS NOT NULL AND t.p IS NOT NULL"""
)
def endpoint_min_distance(s: SparkSession, d: str) -> DataFrame:
    ends = ct.edge_ends(table(s, d, "contracts"), ("endpoints",)).where("a.endpoints is not null and b.endpoints is not null")
    return ends.select("contract_id", "pos", F.round(vectors.endpoint_distance(F.col("a.endpoints"), F.col("b.endpoints")), 6).alias("distance"))


def _points(s: SparkSession, d: str) -> DataFrame:
    fields = ("layer", "geometry_type", "endpoints")
    held = ct.narrowed(table(s, d, "contracts"), F.col("metadata.viewbox").alias("viewbox"), F.col("metadata.epsilon").alias("epsilon"), F.arrays_zip(*(F.col(f"nodes.{f}").alias(f) for f in fields)).alias("nodes"))
    rows = held.select("contract_id", "viewbox", "epsilon", F.posexplode("nodes").alias("pos", "n")).select("contract_id", "viewbox", "epsilon", "pos", "n.*")
    return proximity.contract_points(ct.structural(rows))


@query(
    C
    + """, v AS (SELECT contract_id, coalesce(metadata.epsilon, 0.5) AS eps, coalesce(metadata.viewbox[1], 0) AS x0, coalesce(metadata.viewbox[2], 0) AS y0, coalesce(metadata.viewbox[3], 100) AS w, coalesce(metadata.viewbox[4], 100) AS h FROM c),
pt AS (SELECT n.contract_id, n.pos, layer, (endpoints."start"[1] - x0) / w AS sx, (endpoints."start"[2] - y0) / h AS sy, (endpoints."end"[1] - x0) / w AS ex, (endpoints."end"[2] - y0) / h AS ey, eps / greatest(w, h) AS eps
  FROM n JOIN v USING (contract_id) WHERE coalesce(layer, '') NOT IN ('DIM_LEAD', 'PUB_DIM', 'AXIS', 'layerAXIS', 'WINDOW_TEXT', 'PUB_TEXT', 'PUB_HATCH') AND coalesce(geometry_type, '') <> 'text'
  AND endpoints."start"[2] IS NOT NULL AND endpoints."end"[2] IS NOT NULL),
d AS (SELECT a.contract_id AS plan, a.pos AS i, b.pos AS j, a.eps, least(sqrt((a.sx-b.sx)*(a.sx-b.sx)+(a.sy-b.sy)*(a.sy-b.sy)), sqrt((a.sx-b.ex)*(a.sx-b.ex)+(a.sy-b.ey)*(a.sy-b.ey)), sqrt((a.ex-b.sx)*(a.ex-b.sx)+(a.ey-b.sy)*(a.ey-b.sy)), sqrt((a.ex-b.ex)*(a.ex-b.ex)+(a.ey-b.ey)*(a.ey-b.ey))) AS distance
  FROM pt a JOIN pt b ON a.contract_id = b.contract_id AND a.pos < b.pos)
SELECT plan, i, j, round(distance, 6) AS distance FROM d WHERE distance <= eps"""
)
def proximity_edges(s: SparkSession, d: str) -> DataFrame:
    return proximity.near_pairs(_points(s, d)).select("plan", "i", "j", F.round("distance", 6).alias("distance"))


@query()
def proximity_edges_capped(s: SparkSession, d: str) -> DataFrame:
    return proximity.with_relation(proximity.capped_pairs(proximity.near_pairs(_points(s, d)))).withColumn("distance", F.round("distance", 6))


@query("SELECT contract_id, count(*) AS n_copies FROM contracts WHERE _corrupt_record IS NOT NULL GROUP BY 1")
def corrupt_skipped(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "contracts").where("_corrupt_record is not null").groupBy("contract_id").agg(F.count(F.lit(1)).alias("n_copies"))


@query("SELECT count(*) AS n_total, count(*) FILTER (WHERE _corrupt_record IS NULL) AS n_success, count(*) FILTER (WHERE _corrupt_record IS NOT NULL) AS n_failed FROM contracts")
def batch_counters(s: SparkSession, d: str) -> DataFrame:
    bad = F.col("_corrupt_record").isNotNull()
    return table(s, d, "contracts").agg(F.count(F.lit(1)).alias("n_total"), F.count_if(~bad).alias("n_success"), F.count_if(bad).alias("n_failed"))


@query(
    C
    + """, a AS (SELECT contract_id, geometry_type, unnest(map_entries(raw_attributes)) AS kv FROM n)
SELECT kv.key AS key, count(*) AS n, count(DISTINCT kv.value) AS n_values FROM a WHERE geometry_type = 'text' OR kv.key NOT IN ('d', 'semantic-id', 'instance-id') GROUP BY 1"""
)
def attribute_exclusion(s: SparkSession, d: str) -> DataFrame:
    return ct.free_attributes(_nodes(s, d, "geometry_type", "raw_attributes")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("n_values"))


@query(C + "SELECT layer AS raw, CASE layer WHEN '地饰' THEN 'FLOOR_DECORATION' WHEN '家具' THEN 'FURNITURE' WHEN '装施家具' THEN 'INSTALLED_FURNITURE' ELSE CASE WHEN regexp_matches(layer, '[\\x{4e00}-\\x{9fff}]') THEN layer ELSE replace(upper(replace(replace(layer, 'ß', '\x01'), ' ', '_')), '\x01', 'SS') END END AS layer FROM (SELECT DISTINCT layer FROM n WHERE layer IS NOT NULL)")
def layer_name(s: SparkSession, d: str) -> DataFrame:
    """Every name, in letters of any script."""
    raw = _nodes(s, d, "layer").where("layer is not null").select(F.col("layer").alias("raw")).distinct()
    return raw.select("raw", text.layer_name("raw").alias("layer"))


# ---- plan attributes -------------------------------------------------------


@query("SELECT floor_plan_id, epoch_us(extracted_at) AS at, CASE WHEN coalesce(b, 0) <= 0 THEN 0 WHEN b <= 50 THEN 1 WHEN b <= 150 THEN 2 ELSE 3 END AS bucket FROM (SELECT *, inventory['bed'] AS b FROM plan_attributes)")
def scale_bucket(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "plan_attributes").select("floor_plan_id", F.unix_micros("extracted_at").alias("at"), vectors.scale_bucket(F.try_element_at("inventory", F.lit("bed"))).alias("bucket"))


_INV = """WITH p AS (SELECT row_number() OVER () AS rid, floor_plan_id, source_json, extracted_at, density, adjacencies, inventory FROM plan_attributes),
e AS (SELECT rid, floor_plan_id, source_json, extracted_at, k.key AS label, k.value AS n FROM (SELECT rid, floor_plan_id, source_json, extracted_at, unnest(map_entries(inventory)) AS k FROM p)),
f AS (SELECT * FROM e WHERE lower(label) NOT LIKE '%text%' AND n > 0 AND label NOT IN ('wall', 'window', 'opening_symbol', 'dimension', 'single_door', 'axis', 'floor_decoration', 'hatch', 'installed_furniture', 'column', 'blind_window', 'dote', 'curtwall')),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY n DESC, label) AS rn FROM f),
w AS (SELECT *, CASE WHEN replace(label, '_', ' ') = 'bed' THEN 'bedroom' ELSE replace(label, '_', ' ') END AS noun FROM r WHERE rn <= 4),
ph AS (SELECT *, n || ' ' || CASE WHEN noun = 'furniture' AND n = 1 THEN 'furniture item' WHEN noun = 'furniture' THEN 'furniture items' WHEN n = 1 THEN noun WHEN noun = 'axis' THEN 'axes'
  WHEN regexp_matches(lower(noun), '[^aeiou]y$') THEN substr(noun, 1, length(noun) - 1) || 'ies' WHEN regexp_matches(lower(noun), '(s|x|z|ch|sh)$') THEN noun || 'es' ELSE noun || 's' END AS phrase FROM w),
t AS (SELECT rid, list(phrase ORDER BY rn) AS parts FROM ph GROUP BY 1),
s AS (SELECT p.*, CASE WHEN parts IS NULL THEN 'key interior elements' WHEN len(parts) = 1 THEN parts[1] WHEN len(parts) = 2 THEN parts[1] || ' and ' || parts[2] ELSE array_to_string(parts[1:len(parts)-1], ', ') || ', and ' || parts[len(parts)] END AS items
  FROM p LEFT JOIN t USING (rid))
"""


@query(_INV + "SELECT floor_plan_id, source_json, epoch_us(extracted_at) AS at, label, n, CAST(rn AS INT) AS rank FROM r WHERE rn <= 4")
def top_inventory(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "plan_attributes").select("floor_plan_id", "source_json", F.unix_micros("extracted_at").alias("at"), F.posexplode(text.top_inventory("inventory")).alias("i", "x"))
    return rows.select("floor_plan_id", "source_json", "at", F.col("x.label").alias("label"), (-F.col("x.minus_count")).alias("n"), (F.col("i") + 1).alias("rank"))


@query(_INV + "SELECT floor_plan_id, source_json, epoch_us(extracted_at) AS at, items FROM (SELECT DISTINCT floor_plan_id, source_json, extracted_at, items FROM s)")
def oxford_join(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "plan_attributes").select("floor_plan_id", "source_json", F.unix_micros("extracted_at").alias("at"), text.inventory_phrases("inventory").alias("phrases"))
    return rows.select("floor_plan_id", "source_json", "at", text.listed(F.col("phrases")).alias("items")).distinct()


@query("SELECT noun, n, CASE WHEN n = 1 THEN noun WHEN noun = 'axis' THEN 'axes' WHEN regexp_matches(lower(noun), '[^aeiou]y$') THEN substr(noun, 1, length(noun) - 1) || 'ies' WHEN regexp_matches(lower(noun), '(s|x|z|ch|sh)$') THEN noun || 'es' ELSE noun || 's' END AS word FROM (SELECT DISTINCT CASE WHEN replace(k.key, '_', ' ') = 'bed' THEN 'bedroom' ELSE replace(k.key, '_', ' ') END AS noun, k.value AS n FROM (SELECT unnest(map_entries(inventory)) AS k FROM plan_attributes)) WHERE n IS NOT NULL")
def pluralize(s: SparkSession, d: str) -> DataFrame:
    each = table(s, d, "plan_attributes").select(F.explode("inventory").alias("label", "n")).where("n is not null").select(text.humanise("label").alias("noun"), "n").distinct()
    return each.select("noun", "n", text.pluralise(F.col("noun"), F.col("n")).alias("word"))


_T = "CAST('0x' || substr(md5('42:' || regexp_replace(floor_plan_id, '\\.svg$', '')), 1, 8) AS BIGINT) % 4"


@query(
    _INV
    + f""", a AS (SELECT *, list_transform(coalesce(adjacencies, [])[1:2], lambda x: replace(x, '_', ' ')) AS adj, {_T} AS tpl FROM s),
b AS (SELECT *, CASE WHEN len(adj) = 1 THEN ' Spatially, the ' || adj[1] || '.' WHEN len(adj) = 2 THEN ' Spatially, the ' || adj[1] || ', and the ' || adj[2] || '.' ELSE '' END AS clause FROM a)
SELECT DISTINCT floor_plan_id, source_json, epoch_us(extracted_at) AS at, CASE tpl WHEN 0 THEN 'This is a ' || density || ' layout featuring ' || items WHEN 1 THEN 'A ' || density || ' floor plan with ' || items WHEN 2 THEN 'In this ' || density || ' plan, you can find ' || items
ELSE 'The drawing shows a ' || density || ' arrangement containing ' || items END || '.' || clause AS query FROM b"""
)
def render_query(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "plan_attributes").select("floor_plan_id", "source_json", F.unix_micros("extracted_at").alias("at"), "density", "inventory", "adjacencies")
    return text.with_queries(rows, text.strip_svg("floor_plan_id")).select("floor_plan_id", "source_json", "at", "query").distinct()


# ---- pairs -----------------------------------------------------------------

# DuckDB's expressions have no boundaries of words of all scripts, so words are put between marks first
_BLANK = "[\\s\\x{0b}\\x{1c}-\\x{1f}\\x{85}\\p{Z}]"
_MARKED = [
    ("\x02bhk\x02\\.\x02", "\x02bedroom hall kitchen"), ("\x02bhk\x02", "\x02bedroom hall kitchen\x02"), ("\x02rk\x02", "\x02room kitchen\x02"),
    (f"\x02sq(\x02{_BLANK}+\x02)?ft\x02", "\x02square feet\x02"), ("\x02w\x02/\x02", "\x02with"), ("\x022br\x02", "\x022 bedroom\x02"), ("\x023br\x02", "\x023 bedroom\x02"),
]
_RULES = f"regexp_replace(regexp_replace(lower(query), '^{_BLANK}+|{_BLANK}+$', '', 'g'), '([\\p{{L}}\\p{{N}}_]+)', '\x02\\1\x02', 'g')"
for _a, _b in _MARKED:
    _RULES = f"regexp_replace({_RULES}, '{_a}', '{_b}', 'g')"


@query(f"SELECT pair_id, replace({_RULES}, '\x02', '') AS query FROM pairs WHERE query IS NOT NULL")
def query_normalize(s: SparkSession, d: str) -> DataFrame:
    """Every query that is not null."""
    return table(s, d, "pairs").where("query is not null").select("pair_id", text.normalise_query("query").alias("query"))


@query("SELECT coalesce(scale_bucket, bedroom_count, 0) AS bucket, count(*) AS n FROM pairs GROUP BY 1")
def bucket_histogram(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pairs").groupBy(F.coalesce("scale_bucket", "bedroom_count", F.lit(0)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_K = "CAST('0x' || substr(md5('{seed}:' || pair_id), 1, 8) AS BIGINT)"


@query(
    f"""WITH b AS (SELECT pair_id AS id, coalesce(scale_bucket, bedroom_count, 0) AS stratum, {_K.format(seed=99)} AS key FROM pairs),
r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY key, id) AS nth, greatest(1, 200 // (SELECT count(DISTINCT stratum) FROM b)) AS share FROM b),
f AS (SELECT id, 0 AS late, 0 AS key FROM r WHERE nth <= share UNION ALL SELECT id, 1, key FROM r WHERE nth > share),
t AS (SELECT id, row_number() OVER (ORDER BY late, key, id) AS o FROM f)
SELECT b.id, b.stratum, CASE WHEN o <= 200 THEN 'test' ELSE 'train' END AS split FROM b JOIN t USING (id)"""
)
def stratified_split(s: SparkSession, d: str) -> DataFrame:
    return sampling.stratified_split(table(s, d, "pairs"), "pair_id", F.coalesce("scale_bucket", "bedroom_count", F.lit(0)))


@query(
    f"""WITH r AS (SELECT pair_id AS id, row_number() OVER (ORDER BY {_K.format(seed=42)}, pair_id) AS rn, count(*) OVER () AS n FROM pairs)
SELECT id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor(n * 0.1) THEN 'val' ELSE 'test' END AS split FROM r"""
)
def ratio_split(s: SparkSession, d: str) -> DataFrame:
    return sampling.ratio_split(table(s, d, "pairs"), "pair_id", [("train", 0.8), ("val", 0.1)], "test")


@query(
    f"""WITH r AS (SELECT pair_id AS id, row_number() OVER (ORDER BY {_K.format(seed=7)}, pair_id) AS rn, count(*) OVER () AS n FROM pairs)
SELECT id, CASE WHEN rn <= greatest(1, least(n - 1, floor(n * 0.9))) THEN 'train' ELSE 'val' END AS split FROM r"""
)
def holdout_split(s: SparkSession, d: str) -> DataFrame:
    return sampling.holdout_split(table(s, d, "pairs"), "pair_id", 0.9, 7)


@query(
    f"""WITH r AS (SELECT pair_id AS id, row_number() OVER (ORDER BY {_K.format(seed=42)}, pair_id) AS rn, count(*) OVER () AS n FROM pairs)
SELECT id, CASE WHEN rn <= greatest(1, CAST(floor(n * 0.1) AS BIGINT)) THEN 'val' ELSE 'train' END AS split FROM r"""
)
def random_holdout(s: SparkSession, d: str) -> DataFrame:
    return sampling.random_holdout(table(s, d, "pairs"), "pair_id", 0.1)


@query(f"SELECT id FROM (SELECT pair_id AS id FROM pairs ORDER BY {_K.format(seed=42)}, pair_id LIMIT 500)")
def uniform_subset(s: SparkSession, d: str) -> DataFrame:
    """A sample of a stated size is the feature here."""
    return sampling.subset(table(s, d, "pairs").select(F.col("pair_id").alias("id")), "id", 500)


@query("SELECT DISTINCT p.pair_id AS id, s.split FROM (SELECT unnest(train) AS id, 'train' AS split FROM eval_split UNION ALL SELECT unnest(test), 'test' FROM eval_split) s JOIN pairs p ON p.pair_id = s.id")
def saved_split(s: SparkSession, d: str) -> DataFrame:
    """The saved positions that are records today, on their sides."""
    saved = table(s, d, "eval_split")
    side = lambda c: saved.select(F.explode(F.col(c).cast("array<bigint>")).alias("id"), F.lit(c).alias("split"))
    return sampling.saved_sides(side("train").unionByName(side("test")), table(s, d, "pairs"), "pair_id")


@query(
    f"""WITH b AS (SELECT DISTINCT (row_number() OVER (ORDER BY coalesce(len(nodes), 0), contract_id) - 1) // 32 AS batch FROM (SELECT contract_id, arg_max(nodes, ingested_at) AS nodes FROM contracts WHERE _corrupt_record IS NULL GROUP BY 1))
SELECT batch, row_number() OVER (ORDER BY {_K.format(seed=42).replace('pair_id', 'batch')}, batch) AS position FROM b"""
)
def shuffled_batches(s: SparkSession, d: str) -> DataFrame:
    return sampling.shuffled_batches(sampling.chunk_batches(_sizes(s, d), 32)).select("batch", F.col("position").cast("long").alias("position")).distinct()


@query(
    f"""WITH b AS (SELECT pair_id AS id, scale_bucket AS category, {_K.format(seed=42)} AS key FROM pairs WHERE scale_bucket BETWEEN 0 AND 3),
r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY key, id) - 1 AS rn FROM b), k AS (SELECT greatest(1, 32 // count(*)) AS per, min(c) AS least FROM (SELECT count(*) AS c FROM b GROUP BY category))
SELECT id, category, rn // per AS batch FROM r, k WHERE rn // per < least // per"""
)
def balanced_batches(s: SparkSession, d: str) -> DataFrame:
    return sampling.balanced_batches(table(s, d, "pairs").where("scale_bucket between 0 and 3"), "pair_id", F.col("scale_bucket"), 32)


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return ct.node_counts(table(s, d, "contracts")).select(F.col("contract_id").alias("id"), F.col("n_nodes").cast("long").alias("n"))


@query(C + "SELECT contract_id AS id, coalesce(len(nodes), 0) AS n, (row_number() OVER (ORDER BY coalesce(len(nodes), 0), contract_id) - 1) // 32 AS batch FROM c")
def chunk_batches(s: SparkSession, d: str) -> DataFrame:
    return sampling.chunk_batches(_sizes(s, d), 32)


@query(
    """WITH RECURSIVE c AS (SELECT contract_id AS id, coalesce(len(arg_max(nodes, ingested_at)), 0) AS n FROM contracts WHERE _corrupt_record IS NULL GROUP BY 1),
o AS (SELECT id, n, greatest(n, 1) AS size, row_number() OVER (ORDER BY greatest(n, 1), n, id) AS rn FROM c),
f AS (SELECT rn, id, n, size, CAST(0 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS graphs, CAST(size AS BIGINT) AS nodes FROM o WHERE rn = 1
  UNION ALL SELECT o.rn, o.id, o.n, o.size, f.batch + CASE WHEN x.fits THEN 0 ELSE 1 END, CASE WHEN x.fits THEN f.graphs + 1 ELSE 1 END, CASE WHEN x.fits THEN f.nodes + o.size ELSE o.size END
  FROM f JOIN o ON o.rn = f.rn + 1, LATERAL (SELECT o.size < 2500 AND f.size < 2500 AND f.graphs < 8 AND f.nodes + o.size <= 2500 AS fits) x)
SELECT id, n, batch FROM f"""
)
def next_fit_batches(s: SparkSession, d: str) -> DataFrame:
    return sampling.next_fit_batches(_sizes(s, d), 2500, 8)


_IDX = "SELECT DISTINCT regexp_replace(floor_plan_id, '\\.svg$', '') AS k FROM plan_embeddings"


@query(f"SELECT pair_id FROM pairs WHERE regexp_replace(floor_plan_id, '\\.svg$', '') IN ({_IDX})")
def semi_evaluable(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "plan_embeddings").select(text.strip_svg("floor_plan_id").alias("k")).distinct()
    return table(s, d, "pairs").select("pair_id", text.strip_svg("floor_plan_id").alias("k")).join(ids, "k", "left_semi").select("pair_id")


@query(f"SELECT count(*) AS n_pairs, count(*) FILTER (WHERE regexp_replace(floor_plan_id, '\\.svg$', '') IN ({_IDX})) AS n_covered FROM pairs")
def coverage_count(s: SparkSession, d: str) -> DataFrame:
    ids = table(s, d, "plan_embeddings").select(text.strip_svg("floor_plan_id").alias("k")).distinct().withColumn("held", F.lit(1))
    return table(s, d, "pairs").select(text.strip_svg("floor_plan_id").alias("k")).join(ids, "k", "left").agg(F.count(F.lit(1)).alias("n_pairs"), F.count("held").alias("n_covered"))


@query("SELECT pair_id FROM pairs WHERE pair_id NOT IN (SELECT unnest(test) FROM eval_split)")
def anti_train(s: SparkSession, d: str) -> DataFrame:
    test = table(s, d, "eval_split").select(F.explode(F.col("test").cast("array<bigint>")).alias("pair_id"))
    return table(s, d, "pairs").select("pair_id").join(test, "pair_id", "left_anti")


_BASE = "regexp_extract({}, '([^/\\\\]*)$', 1)"


@query(
    f"""WITH x AS (SELECT source_json, max(row_no) AS row_no FROM plan_embeddings WHERE source_json IS NOT NULL GROUP BY 1),
y AS (SELECT {_BASE.format('source_json')} AS b, max(row_no) AS row_no FROM plan_embeddings WHERE source_json IS NOT NULL GROUP BY 1)
SELECT pair_id, coalesce(x.row_no, y.row_no) AS row_no, CASE WHEN x.row_no IS NOT NULL THEN 'path' WHEN y.row_no IS NOT NULL THEN 'name' ELSE 'parse' END AS via
FROM pairs p LEFT JOIN x ON x.source_json = p.graph_path LEFT JOIN y ON y.b = {_BASE.format('p.graph_path')}"""
)
def cascade_lookup(s: SparkSession, d: str) -> DataFrame:
    index = table(s, d, "plan_embeddings").where("source_json is not null")
    exact = index.groupBy(F.col("source_json").alias("graph_path")).agg(F.max("row_no").alias("x"))
    named = index.groupBy(text.base_name("source_json").alias("base")).agg(F.max("row_no").alias("y"))
    both = table(s, d, "pairs").select("pair_id", "graph_path", text.base_name("graph_path").alias("base")).join(exact, "graph_path", "left").join(named, "base", "left")
    via = F.when(F.col("x").isNotNull(), "path").when(F.col("y").isNotNull(), "name").otherwise("parse")
    return both.select("pair_id", F.coalesce("x", "y").alias("row_no"), via.alias("via"))


@query("SELECT CASE WHEN graph_path LIKE '%/train/%' THEN 'train' WHEN graph_path LIKE '%/test/%' THEN 'test' END AS side, count(*) AS n FROM pairs WHERE graph_path LIKE '%/train/%' OR graph_path LIKE '%/test/%' GROUP BY 1")
def split_by_folder(s: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("graph_path").contains("/train/"), "train").when(F.col("graph_path").contains("/test/"), "test")
    return table(s, d, "pairs").select(side.alias("side")).where("side is not null").groupBy("side").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT floor_plan_id AS raw, regexp_replace(floor_plan_id, '\\.svg$', '') AS plan, regexp_replace(regexp_replace(regexp_extract(graph_path, '([^/\\\\]*)$', 1), '\\.[^.]*$', ''), '_contract$', '') AS stem FROM pairs")
def strip_suffix(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pairs").select(F.col("floor_plan_id").alias("raw"), text.strip_svg("floor_plan_id").alias("plan"), text.plan_stem("graph_path").alias("stem")).distinct()


@query("SELECT pair_id, substr(query, 1, 80) || '...' AS shown FROM pairs WHERE query IS NOT NULL")
def truncate_query(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pairs").where("query is not null").select("pair_id", text.clipped("query").alias("shown"))


@query("SELECT coalesce(scale_bucket, bedroom_count, -1) AS label, greatest(2, (SELECT max(coalesce(scale_bucket, bedroom_count, -1)) + 1 FROM pairs)) AS num_classes, greatest(0, coalesce(scale_bucket, bedroom_count, -1)) AS clamped, count(*) AS n FROM pairs GROUP BY 1, 3")
def class_counts(s: SparkSession, d: str) -> DataFrame:
    label = F.coalesce("scale_bucket", "bedroom_count", F.lit(-1))
    rows = table(s, d, "pairs").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))
    most = rows.agg(F.greatest(F.lit(2), F.max("label") + 1).alias("num_classes"))
    return rows.crossJoin(F.broadcast(most)).select("label", "num_classes", F.greatest(F.lit(0), F.col("label")).alias("clamped"), "n")  # one row


# ---- vectors ---------------------------------------------------------------

E = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS row, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row) AS rank FROM p),
t AS (SELECT query_id, row, score, CAST(rank AS INT) AS rank FROM h WHERE rank <= 10)
"""


def _index(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("row"), "embedding", "label")


def _hits(s: SparkSession, d: str, k: int = 10, drop_self: bool = True) -> DataFrame:
    index = _index(s, d)
    return search.top_k(index.where("row % 20 = 0").select(F.col("row").alias("query_id"), "embedding"), index, k, drop_self=drop_self)


@query(E + "SELECT * FROM t")
def topk_cosine(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d)


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.vec_id AS query_id, b.vec_id AS row, round(list_dot_product(a.e, b.e), 6) AS score FROM v a, v b WHERE a.vec_id % 20 = 0) SELECT query_id, row, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row) AS rn FROM p) WHERE rn = 1")
def self_retrieval(s: SparkSession, d: str) -> DataFrame:
    return _hits(s, d, 1, drop_self=False).select("query_id", "row", "score")


@query("WITH l AS (SELECT regexp_replace(floor_plan_id, '\\.svg$', '') AS k, max(row_no) AS row_no FROM plan_embeddings GROUP BY 1) SELECT DISTINCT p.floor_plan_id AS requested, l.row_no FROM pairs p JOIN l ON l.k = regexp_replace(p.floor_plan_id, '\\.svg$', '')")
def point_lookup_query(s: SparkSession, d: str) -> DataFrame:
    return search.by_plan(table(s, d, "plan_embeddings"), table(s, d, "pairs").select("floor_plan_id").distinct(), strict=False).select("requested", "row_no")


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(list_dot_product(e, e), 5) AS squared, round(e[1] / sqrt(list_dot_product(e, e)), 5) AS first, round(e[64] / sqrt(list_dot_product(e, e)), 5) AS last FROM v")
def l2_normalize(s: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding")
    u = table(s, d, "embeddings").select("vec_id", F.round(vectors.dot(e, e), 5).alias("squared"), vectors.unit(e).alias("u"))
    return u.select("vec_id", "squared", F.round(F.get("u", F.lit(0)), 5).alias("first"), F.round(F.get("u", F.lit(63)), 5).alias("last"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT a.vec_id, round(list_dot_product(a.e, b.e), 6) AS score FROM v a JOIN v b ON b.vec_id = a.vec_id + 1")
def dot_product(s: SparkSession, d: str) -> DataFrame:
    v = table(s, d, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(after, "vec_id").select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("other")), 6).alias("score"))


def _first(s: SparkSession, d: str) -> DataFrame:
    """Rank of the first neighbour with the query's label."""
    labels = _index(s, d).select("row", "label")
    hits = _hits(s, d).join(labels.withColumnRenamed("label", "item"), "row").select("query_id", "item", "rank")
    return metrics.first_hits(hits, labels.where("row % 20 = 0").select(F.col("row").alias("query_id"), F.col("label").alias("item")))


_F = E + """, q AS (SELECT vec_id AS query_id, label AS bucket FROM v WHERE vec_id % 20 = 0),
f AS (SELECT q.query_id, q.bucket, min(t.rank) AS r FROM q LEFT JOIN (SELECT t.*, v.label FROM t JOIN v ON v.vec_id = t.row) t ON t.query_id = q.query_id AND t.label = q.bucket GROUP BY 1, 2)
"""


@query(_F + "SELECT count(*) AS n_queries, " + ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_at_{k}" for k in (1, 5, 10)) + " FROM f")
def recall_at_k(s: SparkSession, d: str) -> DataFrame:
    return metrics.recall(_first(s, d))


@query(_F + "SELECT round(avg(coalesce(1.0::DOUBLE / r, 0)), 6) AS mrr FROM f")
def mrr_at_10(s: SparkSession, d: str) -> DataFrame:
    return metrics.mrr(_first(s, d))


@query(_F + "SELECT bucket, count(*) AS n_queries, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall FROM f GROUP BY 1")
def per_bucket_recall(s: SparkSession, d: str) -> DataFrame:
    return metrics.recall_by(_first(s, d), _index(s, d).where("row % 20 = 0").select(F.col("row").alias("query_id"), F.col("label").alias("bucket")))


_R = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT count(*) AS n FROM v),
g AS (SELECT a.vec_id AS query_id, round(list_dot_product(a.e, b.e), 6) AS own, b.vec_id AS item FROM v a, n JOIN v b ON b.vec_id = (a.vec_id + 1) % n WHERE a.vec_id % 20 = 0),
r AS (SELECT g.query_id, 1 + count(*) FILTER (WHERE s > own OR (s = own AND x < item)) AS rank FROM (SELECT g.*, c.vec_id AS x, round(list_dot_product(a.e, c.e), 6) AS s FROM g JOIN v a ON a.vec_id = g.query_id, v c) g GROUP BY 1)
"""


def _ranks(s: SparkSession, d: str) -> DataFrame:
    """Rank of one right item (the next vector) among all, for every query: one plus the better ones."""
    index = _index(s, d)
    n = index.count()
    return search.rank_of(index.where("row % 20 = 0").select(F.col("row").alias("query_id"), "embedding", ((F.col("row") + 1) % n).alias("right_row")), index)


@query(_R + "SELECT " + ", ".join(f"round(100 * avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 2) AS r_at_{k}" for k in (1, 5, 10)) + ", round(100 * avg(1.0::DOUBLE / rank), 2) AS mrr, round(quantile_disc(rank, 0.5)::DOUBLE, 1) AS median_rank FROM r")
def full_rank_metrics(s: SparkSession, d: str) -> DataFrame:
    return metrics.full_rank_metrics(_ranks(s, d))


_B = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT count(*) AS n FROM v),
w AS (SELECT 'forward' AS direction, vec_id AS query_id, (vec_id + 1) % n AS item FROM v, n WHERE vec_id % 20 = 0 UNION ALL SELECT 'backward', (vec_id + 1) % n, vec_id FROM v, n WHERE vec_id % 20 = 0),
g AS (SELECT w.*, a.e AS q, round(list_dot_product(a.e, b.e), 6) AS own FROM w JOIN v a ON a.vec_id = w.query_id JOIN v b ON b.vec_id = w.item),
r AS (SELECT direction, query_id, 1 + count(*) FILTER (WHERE s > own OR (s = own AND x < item)) AS rank FROM (SELECT g.*, c.vec_id AS x, round(list_dot_product(q, c.e), 6) AS s FROM g, v c) GROUP BY 1, 2)
"""


@query(_B + "SELECT direction, " + ", ".join(f"round(100 * avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0.0 END), 2) AS r_at_{k}" for k in (1, 5, 10)) + ", round(100 * avg(1.0::DOUBLE / rank), 2) AS mrr, round(quantile_disc(rank, 0.5)::DOUBLE, 1) AS median_rank FROM r GROUP BY 1")
def metrics_both_ways(s: SparkSession, d: str) -> DataFrame:
    """Every 20th vector asks for the next one among all, and the next one for it."""
    index = _index(s, d)
    n = index.count()
    asked = index.where("row % 20 = 0").select(F.col("row").alias("a"), ((F.col("row") + 1) % n).alias("b"))
    way = lambda q, r: search.rank_of(asked.select(F.col(q).alias("query_id"), F.col(r).alias("right_row")).join(index.select(F.col("row").alias("query_id"), "embedding"), "query_id"), index)
    return metrics.both_directions(way("a", "b"), way("b", "a"))


_V = """, f AS (SELECT contract_id, id, pos, [coalesce(features.length, 0), coalesce(features.center[1], 0), coalesce(features.center[2], 0)] AS v FROM n),
i AS (SELECT contract_id, id, max(pos) AS node FROM n GROUP BY 1, 2),
b AS (SELECT e.contract_id, s.node AS a, t.node AS b FROM e JOIN i s ON s.contract_id = e.contract_id AND s.id = e.source JOIN i t ON t.contract_id = e.contract_id AND t.id = e.target),
d AS (SELECT contract_id, a AS src, b AS dst FROM b UNION ALL SELECT contract_id, b, a FROM b)
"""


def _node_vectors(s: SparkSession, d: str) -> DataFrame:
    f = F.col("features")
    v = F.array(F.coalesce(f["length"], F.lit(0.0)), vectors.at(f["center"], 0), vectors.at(f["center"], 1))
    return _nodes(s, d, "features").select("contract_id", F.col("pos").alias("node"), v.alias("vector"))


@query(C + _V + "SELECT contract_id, " + ", ".join(f"round({a}(v[{i + 1}]), 6) AS {a}_{i}" for a in ("avg", "max") for i in range(3)) + " FROM f GROUP BY 1")
def graph_pooling(s: SparkSession, d: str) -> DataFrame:
    pooled = encoder.graph_pool(_node_vectors(s, d), ["contract_id"])
    return pooled.select("contract_id", *(F.round(F.get("vector", F.lit(3 * k + i)), 6).alias(f"{a}_{i}") for k, a in enumerate(("avg", "max")) for i in range(3)))


@query(
    C
    + _V
    + ", m AS (SELECT d.contract_id, d.dst, "
    + ", ".join(f"avg(f.v[{i + 1}]) AS m{i}" for i in range(3))
    + " FROM d JOIN f ON f.contract_id = d.contract_id AND f.pos = d.src GROUP BY 1, 2) SELECT f.contract_id, f.pos AS node, "
    + ", ".join(f"round(coalesce(m{i}, 0), 6) AS mean_{i}" for i in range(3))
    + " FROM f LEFT JOIN m ON m.contract_id = f.contract_id AND m.dst = f.pos"
)
def neighbour_means(s: SparkSession, d: str) -> DataFrame:
    ends = ct.edge_ends(table(s, d, "contracts"), ()).select("contract_id", "pos", F.lit(0.0).alias("distance"), F.lit("").alias("relation"), F.col("a.pos").alias("a"), F.col("b.pos").alias("b"))
    means = encoder.neighbour_mean(_node_vectors(s, d), ct.both_ways(ends).select("contract_id", "src", "dst"))
    return means.select("contract_id", "node", *(F.round(F.get("neighbours", F.lit(i)), 6).alias(f"mean_{i}") for i in range(3)))


@query("SELECT label, CAST(i AS INT) AS i, round(avg(x), 6) AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1, 2")
def mean_pooling(s: SparkSession, d: str) -> DataFrame:
    pooled = encoder.mean_pool(table(s, d, "embeddings").select("label", "embedding"), ["label"], "embedding")
    return pooled.select("label", F.posexplode("mean").alias("i", "mean")).withColumn("mean", F.round("mean", 6))


@query(C + ", g AS (SELECT contract_id, max(pos) AS last, count(*) AS k FROM n GROUP BY 1) SELECT c.contract_id, coalesce(k, 0) AS n_nodes FROM c LEFT JOIN g ON g.contract_id = c.contract_id")
def graph_embeddings(s: SparkSession, d: str) -> DataFrame:
    """Contracts under an untrained encoder of three layers; the SQL counts the nodes that each graph was made of."""
    graphs = ct.graph_rows(table(s, d, "contracts"))
    encoded = graph_encoder.encode_graphs(graphs, *graph_encoder.seeded_weights(9))
    held = encoded.where(F.size("embedding") == 16).select("id").join(graphs.select("id", F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n_nodes")), "id")
    return held.withColumnRenamed("id", "contract_id")


@query()
def sparse_feature_rows(s: SparkSession, d: str) -> DataFrame:
    return ct.sparse_features(_nodes(s, d, "layer", "geometry_type", "features", "instance_id", "semantic_id"))


@query("SELECT k, least(k::DOUBLE / n, 1.0) AS recall FROM (SELECT count(*) AS n FROM plan_embeddings), (SELECT unnest([1, 5, 10]) AS k)")
def random_baseline(s: SparkSession, d: str) -> DataFrame:
    return metrics.random_recall(table(s, d, "plan_embeddings").agg(F.count(F.lit(1)).alias("n")))


@query("SELECT n, round(100.0::DOUBLE / n, 6) AS r_at_1, round(100 * (SELECT sum(1.0::DOUBLE / i) FROM range(1, (SELECT count(*) + 1 FROM embeddings)) t(i)) / n, 6) AS mrr FROM (SELECT count(*) AS n FROM embeddings)")
def harmonic_baseline(s: SparkSession, d: str) -> DataFrame:
    return metrics.random_ranks(table(s, d, "embeddings").agg(F.count(F.lit(1)).alias("n")))


@query(E + "SELECT a.label, count(DISTINCT t.query_id) AS n_queries, round(sum(CASE WHEN a.label = b.label THEN 1.0::DOUBLE ELSE 0 END) / (count(DISTINCT t.query_id) * 10), 6) AS precision FROM t JOIN v a ON a.vec_id = t.query_id JOIN v b ON b.vec_id = t.row GROUP BY 1")
def precision_at_k_label(s: SparkSession, d: str) -> DataFrame:
    return metrics.label_precision(_hits(s, d), _index(s, d).select("row", "label"))


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), p AS (SELECT a.label, a.label = b.label AS own, list_dot_product(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id) SELECT label, (SELECT count(*) FROM v x WHERE x.label = p.label) AS n, round(avg(s) FILTER (WHERE own), 6) AS within, round(avg(s) FILTER (WHERE NOT own), 6) AS across FROM p GROUP BY 1")
def intra_cross_similarity(s: SparkSession, d: str) -> DataFrame:
    return metrics.group_similarity(table(s, d, "embeddings"), 64)


@query("SELECT query_id, round(list_max(s) - list_min(s), 6) AS spread, CASE WHEN len(s) > 1 THEN round(list_reverse_sort(s)[1] - list_reverse_sort(s)[2], 6) END AS gap FROM (SELECT query_id, list_filter(top_k_scores, lambda x: x IS NOT NULL) AS s FROM baseline_retrieval_results WHERE top_k_scores IS NOT NULL)")
def score_spread_gap(s: SparkSession, d: str) -> DataFrame:
    return metrics.score_spread(table(s, d, "baseline_retrieval_results"))


@query(_F + ", m AS (SELECT " + ", ".join(f"round(avg(CASE WHEN r <= {k} THEN 1.0 ELSE 0.0 END), 6) AS k{k}" for k in (1, 5, 10)) + " FROM f), z AS (SELECT count(*) AS n FROM v) " + " UNION ALL ".join(f"SELECT 'recall_at_{k}' AS metric, least({k}.0::DOUBLE / n, 1) AS before, k{k} AS after, round(k{k} - least({k}.0::DOUBLE / n, 1), 6) AS delta FROM m, z" for k in (1, 5, 10)))
def metric_delta(s: SparkSession, d: str) -> DataFrame:
    measured = metrics.tidy(metrics.recall(_first(s, d)).drop("n_queries"))
    random = metrics.random_recall(table(s, d, "embeddings").agg(F.count(F.lit(1)).alias("n"))).select(F.concat(F.lit("recall_at_"), "k").alias("metric"), F.col("recall").alias("value"))
    return metrics.metric_delta(random, measured)


@query("SELECT count(*) AS n_rows, count(DISTINCT row_no) AS n_distinct, count(*) FILTER (WHERE embedding IS NULL) AS n_null, count(*) FILTER (WHERE len(embedding) <> 256) AS n_other_length, count(*) FILTER (WHERE embedding IS NOT NULL AND (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0)) AS n_not_finite, count(*) FILTER (WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0 AND abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 0.01) AS n_not_unit FROM plan_embeddings")
def embedding_integrity(s: SparkSession, d: str) -> DataFrame:
    return search.integrity(table(s, d, "plan_embeddings"), 256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
