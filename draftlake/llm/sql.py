"""SQL that DuckDB runs on the same tables, for the problems that SQL can express."""

_ITEMS = """
WITH rows_ AS (
  SELECT regexp_replace(floor_plan_id, '\\.svg$', '') AS basket, inventory, adjacencies FROM plan_attributes WHERE floor_plan_id IS NOT NULL),
raw AS (
  SELECT basket, NULL AS item FROM rows_
  UNION ALL SELECT basket, e.key FROM (SELECT basket, unnest(map_entries(inventory)) AS e FROM rows_) WHERE e.value > 0
  UNION ALL SELECT basket, regexp_extract(a, '(?i)^(.*?)\\s+is\\s+adjacent\\s+to\\s+the\\s+(.*)$', 1) FROM (SELECT basket, unnest(adjacencies) AS a FROM rows_)
  UNION ALL SELECT basket, regexp_extract(a, '(?i)^(.*?)\\s+is\\s+adjacent\\s+to\\s+the\\s+(.*)$', 2) FROM (SELECT basket, unnest(adjacencies) AS a FROM rows_)),
clean AS (
  SELECT DISTINCT basket, nullif(regexp_replace(regexp_replace(lower(item), '^[\\s.]+|[\\s.]+$', '', 'g'), '[\\s_-]+', '_', 'g'), '') AS item FROM raw),
total AS (SELECT count(DISTINCT basket) AS n FROM clean),
single AS (SELECT item, count(*) AS n_item FROM clean WHERE item IS NOT NULL GROUP BY item),
pairs_ AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM clean a JOIN clean b ON a.basket = b.basket AND a.item < b.item GROUP BY 1, 2),
scored AS (
  SELECT item_a, item_b, n_ab, x.n_item AS n_a, y.n_item AS n_b, n FROM pairs_ JOIN single x ON x.item = item_a JOIN single y ON y.item = item_b, total)
"""

_TERMS = """
WITH one AS (
  SELECT contract_id, arg_max(nodes, coalesce(len(nodes), 0)) AS nodes FROM contracts WHERE contract_id IS NOT NULL GROUP BY contract_id),
n AS (SELECT contract_id, unnest(nodes) AS x FROM one),
t AS (
  SELECT 'semantic_label' AS field_name, lower(trim(x.semantic_label)) AS term, contract_id FROM n
  UNION ALL SELECT 'layer', lower(trim(x.layer)), contract_id FROM n),
total AS (SELECT count(DISTINCT contract_id) AS total FROM contracts),
c AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT contract_id) AS records FROM t WHERE term IS NOT NULL AND term <> '' GROUP BY 1, 2),
m AS (SELECT field_name, term, occurrences, records, round(records / total, 6) AS share,
  CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.4 * total THEN 'common' END AS mark FROM c, total)
"""

_TOPK = """
WITH v AS (
  SELECT row_no, embedding::DOUBLE[] AS e FROM plan_embeddings
  WHERE len(embedding) = 256 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT *, list_dot_product(e, e) AS q FROM v),
p AS (SELECT a.row_no, b.row_no AS similar_row, list_dot_product(a.e, b.e) / sqrt(a.q * b.q) AS score FROM s a JOIN s b ON a.row_no <> b.row_no WHERE a.row_no % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, similar_row) AS rank FROM p)
SELECT row_no, CAST(rank AS INT) AS rank, similar_row, round(score, 4) AS score FROM r WHERE rank <= 10
"""

_NEEDS = """
WITH e AS (SELECT pair_id, min(scale_bucket) AS scale_bucket FROM pairs WHERE scale_bucket BETWEEN 0 AND 3 GROUP BY pair_id),
a AS (SELECT scale_bucket, count(*) AS available FROM e GROUP BY 1),
t AS (SELECT s.*, greatest(min_rows, CAST(ceil((SELECT count(*) FROM e) * sample_permille * target_permille / 1000000.0) AS BIGINT)) AS need FROM sample_targets s)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_topk_queries": _TOPK,
        "p3_found": _TERMS + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
        "p3_term_counts": _TERMS + "SELECT * FROM m",
        "p5_found": _ITEMS + "SELECT item_a, item_b FROM scored WHERE n_ab >= 5 AND n_ab * 1000 >= n AND n_ab * n >= 3 * n_a * n_b",
        "p5_item_pairs": _ITEMS + "SELECT *, round(n_ab * n::DOUBLE / (n_a * n_b), 6) AS lift, round(log2(n_ab * n::DOUBLE / (n_a * n_b)), 6) AS pmi FROM scored",
        "p6_found": _NEEDS + "SELECT request_id, t.scale_bucket FROM t LEFT JOIN a USING (scale_bucket) WHERE need > coalesce(available, 0)",
        "p6_report": _NEEDS
        + "SELECT request_id, t.scale_bucket, need, coalesce(available, 0) AS available, least(need, coalesce(available, 0)) AS quota, greatest(need - coalesce(available, 0), 0) AS shortfall FROM t LEFT JOIN a USING (scale_bucket)",
        "p6_drawn_shares": _NEEDS + "SELECT request_id, t.scale_bucket, least(need, coalesce(available, 0)) AS n_drawn FROM t LEFT JOIN a USING (scale_bucket)",
    }
