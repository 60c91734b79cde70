"""Independent SQL statement of each registered query, runnable by DuckDB on the raw tables.

Used as the correctness oracle: it shares no code path with the Spark plans, only the
definitions (fixture views as CTEs, the integer shuffle rule, rounding at the output).
"""

from __future__ import annotations

from lookalike.sources.tables import ENTITY_FEATURES, LINE_FEATURES, ORDER_LINE_FEATURES


def R(expr: str, d: int = 6) -> str:
    """Round half-up on the shortest decimal text, six further digits first, as the Spark side does."""
    return (f"(CAST(round(round(TRY_CAST(CAST(({expr})::DOUBLE AS VARCHAR) AS DECIMAL(38, 12)), {d + 6}), {d}) "
            f"AS DOUBLE) + 0.0)")


MONEY = 2

EF = """ef AS (
  SELECT c.c_custkey AS entity_id, c.c_nationkey AS region, c.c_mktsegment AS segment, c.c_name AS name,
         CAST(c.c_acctbal AS DOUBLE) AS acctbal,
         CAST(coalesce(o.n_orders, 0) AS DOUBLE) AS n_orders, coalesce(o.total, 0.0) AS total,
         coalesce(o.avg_total, 0.0) AS avg_total, coalesce(o.max_total, 0.0) AS max_total,
         CAST(coalesce(o.n_status_f, 0) AS DOUBLE) AS n_status_f
  FROM customer c LEFT JOIN (
    SELECT o_custkey, count(o_orderkey) AS n_orders, sum(o_totalprice) AS total, avg(o_totalprice) AS avg_total,
           max(o_totalprice) AS max_total, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_status_f
    FROM orders GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey)"""

EF_MONEY = {"acctbal", "total", "avg_total", "max_total"}

PIVOT_KEY = {
    "status": "'status_' || o_orderstatus",
    "priority": "'prio_' || substr(o_orderpriority, 1, 1)",
    "year": "'y' || CAST(year(o_orderdate) AS VARCHAR)",
    "quarter": "'q' || CAST(year(o_orderdate) AS VARCHAR) || '_' || CAST(quarter(o_orderdate) AS VARCHAR)",
    "month": "'m' || strftime(o_orderdate, '%Y%m')",
}


def cells(by: str, name: str | None = None) -> str:
    """Existing (entity, feature) cells of a pivot: avg order price per customer and key."""
    return f"""{name or 'cells'} AS (
  SELECT o_custkey AS entity_id, {PIVOT_KEY[by]} AS feature, avg(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)"""


def grid(src: str = "cells", name: str = "grid") -> str:
    """Every customer × every feature, with NULL where the customer has no such order."""
    return f"""{name} AS (
  SELECT c.c_custkey AS entity_id, f.feature, x.value
  FROM customer c CROSS JOIN (SELECT DISTINCT feature FROM {src}) f
  LEFT JOIN {src} x ON x.entity_id = c.c_custkey AND x.feature = f.feature)"""


def ef_long(features=ENTITY_FEATURES, src="ef", name="efl") -> str:
    parts = [f"SELECT entity_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM {src}" for f in features]
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


LF = """lf AS (
  SELECT l_orderkey * 10 + l_linenumber AS entity_id, l_returnflag AS region, l_linestatus AS segment,
         l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)"""

OL = """ol AS (
  SELECT l_orderkey AS entity_id, CAST(count(*) AS DOUBLE) AS n_lines, sum(l_quantity) AS sum_qty,
         sum(l_extendedprice) AS sum_price, sum(l_extendedprice * (1 - l_discount)) AS sum_revenue,
         sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS sum_charge,
         sum(l_extendedprice * (1 + l_tax)) AS sum_gross, avg(l_discount) AS avg_disc
  FROM lineitem GROUP BY l_orderkey)"""

VEC = """vec AS (
  SELECT vec_id AS entity_id, label AS region, CAST(vec_id % 4 AS INTEGER) AS segment,
         CAST(embedding AS DOUBLE[]) AS features FROM embeddings)"""

VEC_LONG = """vl AS (
  SELECT entity_id, i - 1 AS dim, features[i] AS x
  FROM vec, range(1, len(features) + 1) r(i))"""

PRED = """pred AS (
  SELECT vec_id AS entity_id, label, CAST(vec_id % 10 AS INTEGER) AS prediction FROM embeddings)"""

HASH_LABELS = """hl AS (
  SELECT CAST(k AS INTEGER) AS k, entity_id, CAST(entity_id % k AS INTEGER) AS segment
  FROM vec, (VALUES (2), (3), (4), (5), (6), (7)) ks(k))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def pair_r(a: str, b: str, src: str) -> str:
    return (f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
            f"covar_samp(CASE WHEN {b} IS NOT NULL THEN {a} END, CASE WHEN {a} IS NOT NULL THEN {b} END) / "
            f"nullif(stddev_samp(CASE WHEN {b} IS NOT NULL THEN {a} END) * "
            f"stddev_samp(CASE WHEN {a} IS NOT NULL THEN {b} END), 0) AS r, {{pa}} AS pos_a, {{pb}} AS pos_b FROM {src}")


def corr_long(features, src: str, name: str = "corr") -> str:
    parts = []
    for i, a in enumerate(features):
        for j, b in enumerate(features):
            if i == j:
                parts.append(f"SELECT '{a}' AS feature_a, '{a}' AS feature_b, 1.0::DOUBLE AS r, {i} AS pos_a, {i} AS pos_b")
            else:
                parts.append(pair_r(a, b, src).format(pa=i, pb=j))
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


def z_ef(weights: dict | None = None) -> str:
    weights = weights or {}
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in ENTITY_FEATURES)
    zs = ", ".join(
        f"CASE WHEN s_{f} > 0 THEN ({f} - m_{f}) / s_{f} ELSE 0.0 END * {float(weights.get(f, 1.0))} AS {f}"
        for f in ENTITY_FEATURES)
    return f"""st AS (SELECT {stats} FROM ef),
z AS (SELECT entity_id, region, segment, {zs} FROM ef, st)"""


def cos_pairs(rule: str) -> str:
    dot = " + ".join(f"a.{f} * b.{f}" for f in ENTITY_FEATURES)
    na = "sqrt(" + " + ".join(f"a.{f} * a.{f}" for f in ENTITY_FEATURES) + ")"
    nb = "sqrt(" + " + ".join(f"b.{f} * b.{f}" for f in ENTITY_FEATURES) + ")"
    return f"""pairs AS (
  SELECT a.segment, a.entity_id AS a_id, a.region AS a_region, b.entity_id AS b_id, b.region AS b_region,
         CASE WHEN {na} > 0 AND {nb} > 0 THEN ({dot}) / ({na} * {nb}) ELSE 0.0 END AS sim
  FROM z a JOIN z b ON a.segment = b.segment AND {rule}),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY a_id, b_region ORDER BY sim DESC, b_id) AS rn
  FROM pairs WHERE sim >= 0.0)"""


D3 = with_(EF, z_ef(), cos_pairs("a.region < b.region")) + f"""
SELECT segment, a_id, a_region, b_id, b_region, {R('sim')} AS similarity FROM ranked WHERE rn <= 10"""

D2_CTE = """nn AS (
  SELECT a.entity_id AS a_id, a.region AS a_region, a.segment, b.entity_id AS b_id, b.region AS b_region,
         CASE WHEN list_inner_product(a.features, a.features) > 0 AND list_inner_product(b.features, b.features) > 0
              THEN list_inner_product(a.features, b.features)
                   / (sqrt(list_inner_product(a.features, a.features)) * sqrt(list_inner_product(b.features, b.features)))
              ELSE 0.0 END AS sim
  FROM vec a JOIN vec b ON a.entity_id <> b.entity_id),
nnr AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) AS rn FROM nn),
d2 AS (SELECT segment, a_id, a_region, b_id, b_region, sim AS similarity FROM nnr
       WHERE rn <= 10 AND a_region <> b_region AND sim >= 0.0)"""


def hist_sql(src: str, bins: int = 50) -> str:
    return f"""st AS (SELECT min(similarity) AS lo0, max(similarity) AS hi0 FROM {src}),
rg AS (SELECT CASE WHEN hi0 = lo0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
              CASE WHEN hi0 = lo0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM st),
w AS (SELECT lo, (hi - lo) / {bins} AS width FROM rg),
b AS (SELECT CAST(least(floor((similarity - w.lo) / w.width), {bins - 1}) AS INTEGER) AS bin, count(*) AS n
      FROM {src}, w GROUP BY 1),
allb AS (SELECT CAST(range AS INTEGER) AS bin FROM range({bins}))
SELECT allb.bin, {R('w.lo + allb.bin * w.width')} AS lower, {R('w.lo + (allb.bin + 1) * w.width')} AS upper,
       CAST(coalesce(b.n, 0) AS BIGINT) AS n
FROM allb CROSS JOIN w LEFT JOIN b ON b.bin = allb.bin"""


def density_sql(src: str, grid_n: int = 200, cut: float = 3.0) -> str:
    return f"""st AS (SELECT min(similarity) AS lo, max(similarity) AS hi, count(similarity) AS n,
                   stddev_samp(similarity) AS sd FROM {src}),
bw AS (SELECT *, sd * pow(n, -1.0 / 5) AS h FROM st),
g AS (SELECT *, lo - {cut} * h AS start, ((hi + {cut} * h) - (lo - {cut} * h)) / {grid_n - 1} AS step FROM bw),
pts AS (SELECT CAST(range AS INTEGER) AS point FROM range({grid_n}))
SELECT pts.point, {R('g.start + pts.point * g.step', 4)} AS x,
       {R('sum(exp(-pow(((g.start + pts.point * g.step) - s.similarity) / g.h, 2) / 2)) / (g.n * g.h * sqrt(2 * pi()))', 4)} AS density
FROM pts CROSS JOIN g CROSS JOIN {src} s
GROUP BY pts.point, g.start, g.step, g.n, g.h"""


def var_shares() -> str:
    return VEC_LONG + """,
vs AS (SELECT 'd' || CAST(dim AS VARCHAR) AS feature, var_samp(x) AS v FROM vl GROUP BY dim),
imp AS (SELECT feature, v / sum(v) OVER () AS importance FROM vs)"""


def silhouette_cte() -> str:
    return """sd AS (
  SELECT l1.k, a.entity_id AS a_id, l1.segment AS a_seg, l2.segment AS b_seg,
         CASE WHEN a.entity_id = b.entity_id THEN 0.0 ELSE list_distance(a.features, b.features) END AS dist
  FROM vec a JOIN hl l1 ON l1.entity_id = a.entity_id
  JOIN hl l2 ON l2.k = l1.k
  JOIN vec b ON b.entity_id = l2.entity_id),
per AS (SELECT k, a_id, a_seg, b_seg, sum(dist) AS s, count(*) AS c FROM sd GROUP BY ALL),
rowv AS (SELECT k, a_id,
           max(CASE WHEN a_seg = b_seg THEN s / nullif(c - 1, 0) END) AS a,
           min(CASE WHEN a_seg <> b_seg THEN s / c END) AS b,
           max(CASE WHEN a_seg = b_seg THEN c END) AS size FROM per GROUP BY k, a_id),
sil AS (SELECT k, avg(CASE WHEN size <= 1 OR b IS NULL THEN 0.0
                           ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0.0) END) AS silhouette
        FROM rowv GROUP BY k)"""


def inertia_cte() -> str:
    return VEC_LONG + """,
cellv AS (SELECT hl.k, hl.segment, vl.dim, count(*) AS n, sum(vl.x) AS s, sum(vl.x * vl.x) AS ss
          FROM hl JOIN vl ON vl.entity_id = hl.entity_id GROUP BY ALL),
inertia AS (SELECT k, sum(ss - s * s / n) AS inertia FROM cellv GROUP BY k)"""


def per_class_cte() -> str:
    return """ev AS (SELECT label AS cls, CASE WHEN label = prediction THEN 1 ELSE 0 END AS tp, 1 AS is_true, 0 AS is_pred FROM pred
        UNION ALL SELECT prediction, 0, 0, 1 FROM pred),
pc AS (SELECT cls, sum(tp) AS tp, sum(is_true) AS support, sum(is_pred) AS n_pred FROM ev GROUP BY cls),
prf AS (SELECT *, coalesce(tp * 1.0 / nullif(n_pred, 0), 0.0) AS precision,
                  coalesce(tp * 1.0 / nullif(support, 0), 0.0) AS recall FROM pc),
prf2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
         FROM prf)"""


ASSIGN = """asg AS (
  SELECT CAST(c_custkey AS VARCHAR) AS entity_id, lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS region_code,
         c_mktsegment AS segment FROM customer)"""

EXCLUDED = "('02', '15', '60', '66', '69', '72', '78')"

FLAG_SCORES = f"""q AS (SELECT {', '.join(f"quantile_cont({f}, 0.25) AS q1_{f}, quantile_cont({f}, 0.75) AS q3_{f}" for f in ENTITY_FEATURES)} FROM ef),
fl AS (SELECT ef.entity_id, ({' + '.join(
    f"CASE WHEN {f} < q1_{f} - 1.5 * (q3_{f} - q1_{f}) OR {f} > q3_{f} + 1.5 * (q3_{f} - q1_{f}) THEN 1 ELSE 0 END"
    for f in ENTITY_FEATURES)}) AS n_flags FROM ef, q),
sc AS (SELECT entity_id, -(n_flags * 100.0 / {len(ENTITY_FEATURES)}) / 100.0 AS score, n_flags FROM fl)"""


def _iqr_cols(src_features, money=True):
    d = MONEY if money else 6
    return d


def sql_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    ef_cols = ", ".join(R(f, MONEY) + f" AS {f}" if f in EF_MONEY else R(f) + f" AS {f}" for f in ENTITY_FEATURES)

    q["read_entities"] = f"""SELECT c_custkey AS entity_id, c_name, c_nationkey, {R('c_acctbal', MONEY)} AS c_acctbal,
       c_mktsegment FROM customer"""
    q["integrate_sources"] = f"""WITH o AS (SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total FROM orders GROUP BY 1),
po AS (SELECT l_orderkey, sum(l_quantity) AS qty, count(*) AS lines FROM lineitem GROUP BY 1),
li AS (SELECT o_custkey, sum(qty) AS quantity, sum(lines) AS lines FROM orders JOIN po ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey AS entity_id, c_nationkey AS region, c_mktsegment AS segment, o.n_orders AS ord_n_orders,
       {R('o.total', MONEY)} AS ord_total, {R('li.quantity')} AS li_quantity, CAST(li.lines AS BIGINT) AS li_lines
FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN li ON li.o_custkey = c_custkey"""
    q["write_artifact"] = with_(ASSIGN) + "SELECT entity_id, region_code, segment FROM asg"
    q["read_artifact"] = with_(ASSIGN) + "SELECT entity_id, region_code, segment FROM asg WHERE segment IS NOT NULL"
    q["export_assignments"] = with_(ASSIGN) + "SELECT entity_id, region_code, segment FROM asg"

    q["split_columns"] = with_(EF) + f"SELECT entity_id, {ef_cols} FROM ef"
    q["drop_sparse_features"] = with_(cells("quarter")) + f""", n AS (SELECT count(*) AS n FROM customer),
share AS (SELECT feature, (n.n - count(*)) / n.n AS miss FROM cells, n GROUP BY feature, n.n)
SELECT entity_id, feature, {R('value', MONEY)} AS value FROM cells JOIN share USING (feature) WHERE miss <= 0.8"""
    lf_long = "\n  UNION ALL ".join(
        f"SELECT entity_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value FROM lf" for f in LINE_FEATURES)
    q["drop_low_variance"] = with_(LF, f"lfl AS ({lf_long})") + f""", v AS (SELECT feature, var_samp(value) AS var FROM lfl GROUP BY feature)
SELECT entity_id, feature, {R('value', MONEY)} AS value FROM lfl JOIN v USING (feature)
WHERE (v.var >= 0.01 OR v.var IS NULL) AND value IS NOT NULL"""
    q["exclude_regions"] = with_(ASSIGN) + f"SELECT entity_id, region_code, segment FROM asg WHERE region_code IS NULL OR region_code NOT IN {EXCLUDED}"
    q["relabel"] = """SELECT c_custkey AS entity_id,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Automobile' WHEN 'BUILDING' THEN 'Building'
                         WHEN 'MACHINERY' THEN 'Machinery' ELSE c_mktsegment END AS segment_label FROM customer"""

    q["attach_labels"] = with_(EF) + f"SELECT entity_id, region, {ef_cols}, segment FROM ef"
    q["attach_scores"] = with_(EF, FLAG_SCORES) + f"""SELECT c_custkey AS entity_id, c_nationkey AS region, {R('sc.score')} AS score
FROM customer LEFT JOIN (SELECT * FROM sc WHERE score < 0) sc ON sc.entity_id = c_custkey"""
    q["attach_ids"] = f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT event_id AS entity_id, user_id, event_type,
       {R('CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END')} AS value
FROM events, b WHERE value < lo OR value > hi"""
    q["rank_aligned_pairs"] = with_(EF) + """, s AS (
  SELECT entity_id, segment, region,
         row_number() OVER (PARTITION BY segment, region ORDER BY (entity_id * 7919) % 10007, entity_id) AS rk FROM ef)
SELECT a.segment, a.rk, a.entity_id AS a_id, a.region AS a_region, b.entity_id AS b_id, b.region AS b_region
FROM s a JOIN s b ON a.segment = b.segment AND a.rk = b.rk AND a.region < b.region
WHERE a.rk <= 10"""
    q["topk_similarity"] = with_(VEC) + f""", nn AS (
  SELECT a.entity_id AS a_id, b.entity_id AS b_id,
         CASE WHEN list_inner_product(a.features, a.features) > 0 AND list_inner_product(b.features, b.features) > 0
              THEN list_inner_product(a.features, b.features)
                   / (sqrt(list_inner_product(a.features, a.features)) * sqrt(list_inner_product(b.features, b.features)))
              ELSE 0.0 END AS sim
  FROM vec a JOIN vec b ON a.entity_id <> b.entity_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY sim DESC, b_id) AS rn FROM nn)
SELECT a_id, b_id, {R('sim')} AS similarity FROM r WHERE rn <= 5"""

    miss_year = with_(cells("year")) + """, n AS (SELECT count(*) AS n FROM customer),
mp AS (SELECT feature, n.n - count(*) AS missing_count, (n.n - count(*)) * 100.0 / n.n AS missing_percent
       FROM cells, n GROUP BY feature, n.n HAVING n.n - count(*) > 0)
"""
    q["missing_profile"] = miss_year + f"SELECT feature, CAST(missing_count AS BIGINT) AS missing_count, {R('missing_percent')} AS missing_percent FROM mp"
    q["missing_summary"] = (with_(cells("quarter")) + """, n AS (SELECT count(*) AS n FROM customer),
mp AS (SELECT feature, n.n - count(*) AS missing_count, (n.n - count(*)) * 100.0 / n.n AS missing_percent
       FROM cells, n GROUP BY feature, n.n HAVING n.n - count(*) > 0)
""" + f"""SELECT CAST(min(missing_count) AS BIGINT) AS min_missing, CAST(max(missing_count) AS BIGINT) AS max_missing,
       {R('avg(missing_count)')} AS mean_missing, {R('min(missing_percent)')} AS min_percent,
       {R('max(missing_percent)')} AS max_percent, {R('avg(missing_percent)')} AS mean_percent FROM mp""")
    q["quality_report"] = with_(EF, ef_long()) + f"""SELECT feature, {R('avg(value)', MONEY)} AS mean, {R('quantile_cont(value, 0.5)', MONEY)} AS median,
       {R('stddev_samp(value)', MONEY)} AS std, {R('min(value)', MONEY)} AS min, {R('max(value)', MONEY)} AS max,
       {R('CASE WHEN count(value) < 3 THEN NULL WHEN var_pop(value) = 0 THEN 0.0 ELSE skewness(value) END')} AS skewness,
       {R('CASE WHEN count(value) < 4 THEN NULL WHEN var_pop(value) = 0 THEN 0.0 ELSE kurtosis(value) END')} AS kurtosis
FROM efl GROUP BY feature"""
    q["describe_features"] = with_(cells("status"), grid()) + f"""SELECT feature, count(value) AS count, {R('avg(value)', MONEY)} AS mean,
       {R('stddev_samp(value)', MONEY)} AS std, {R('min(value)', MONEY)} AS min,
       {R('quantile_cont(value, 0.25)', MONEY)} AS p25, {R('quantile_cont(value, 0.5)', MONEY)} AS p50,
       {R('quantile_cont(value, 0.75)', MONEY)} AS p75, {R('max(value)', MONEY)} AS max,
       count(*) - count(value) AS missing, {R('(count(*) - count(value)) * 100.0 / count(*)')} AS missing_percent
FROM grid GROUP BY feature"""
    q["correlation_matrix"] = with_(EF, corr_long(ENTITY_FEATURES, "ef")) + f"SELECT feature_a, feature_b, {R('r')} AS r FROM corr"
    q["high_correlations"] = with_(EF, corr_long(ENTITY_FEATURES, "ef")) + f"""SELECT feature_a, feature_b, {R('abs(r)')} AS abs_r FROM corr
WHERE feature_a <> feature_b AND abs(r) > 0.8"""
    q["extreme_correlations"] = with_(OL, corr_long(ORDER_LINE_FEATURES, "ol")) + f"""SELECT feature_a AS feature1, feature_b AS feature2, {R('r')} AS r FROM corr
WHERE pos_a > pos_b AND abs(r) > 0.95"""
    q["prune_correlated"] = with_(OL, corr_long(ORDER_LINE_FEATURES, "ol")) + """, ex AS (SELECT * FROM corr WHERE pos_a > pos_b AND abs(r) > 0.95),
top AS (SELECT * FROM ex WHERE (SELECT count(*) FROM ex) > 5 ORDER BY abs(r) DESC, pos_a, pos_b LIMIT 5),
""" + ", ".join([]) + "var AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, var_samp({f}) AS v FROM ol" for f in ORDER_LINE_FEATURES) + """)
SELECT DISTINCT CASE WHEN v1.v > v2.v THEN top.feature_b ELSE top.feature_a END AS feature
FROM top JOIN var v1 ON v1.feature = top.feature_a JOIN var v2 ON v2.feature = top.feature_b"""
    box_feats = ENTITY_FEATURES[:5]
    q["box_summary"] = with_(EF, ef_long(box_feats)) + f""", qq AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS med,
       quantile_cont(value, 0.75) AS q3 FROM efl GROUP BY feature),
bb AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qq)
SELECT e.feature, {R('bb.q1', MONEY)} AS q1, {R('bb.med', MONEY)} AS median, {R('bb.q3', MONEY)} AS q3,
       {R('min(CASE WHEN value >= lo THEN value END)', MONEY)} AS whisker_low,
       {R('max(CASE WHEN value <= hi THEN value END)', MONEY)} AS whisker_high,
       count(CASE WHEN value < lo OR value > hi THEN 1 END) AS n_fliers, 'before' AS stage
FROM efl e JOIN bb ON bb.feature = e.feature GROUP BY e.feature, bb.q1, bb.med, bb.q3"""

    q["split_by_missing"] = with_(cells("status", "c1"), cells("year", "c2")) + f""", allc AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2),
n AS (SELECT count(*) AS n FROM customer),
s AS (SELECT feature, (n.n - count(*)) / n.n AS missing_share FROM allc, n GROUP BY feature, n.n)
SELECT feature, {R('missing_share')} AS missing_share,
       CASE WHEN missing_share < 0.1 THEN 'knn' ELSE 'iterative' END AS method FROM s"""
    q["median_fill"] = with_(cells("status"), grid()) + f""", med AS (SELECT feature, quantile_cont(value, 0.5) AS m FROM grid GROUP BY feature)
SELECT entity_id, feature, {R('coalesce(value, m)', MONEY)} AS value FROM grid JOIN med USING (feature)"""
    iqr = f""", qq AS (SELECT feature, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM efl GROUP BY feature),
bb AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM qq)
"""
    q["iqr_bounds"] = with_(EF, ef_long()) + iqr + f"""SELECT e.feature, {R('bb.q1', MONEY)} AS q1, {R('bb.q3', MONEY)} AS q3, {R('bb.lo', MONEY)} AS lower,
       {R('bb.hi', MONEY)} AS upper, count(CASE WHEN value < lo OR value > hi THEN 1 END) AS n_outliers,
       {R('count(CASE WHEN value < lo OR value > hi THEN 1 END) * 100.0 / count(*)')} AS outlier_percent
FROM efl e JOIN bb ON bb.feature = e.feature GROUP BY e.feature, bb.q1, bb.q3, bb.lo, bb.hi"""
    q["winsorize_iqr"] = with_(EF, ef_long()) + iqr + ", cap AS (SELECT e.entity_id, e.feature, CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END AS v FROM efl e JOIN bb ON bb.feature = e.feature)\n" + \
        "SELECT entity_id, " + ", ".join(
            f"{R(f'max(CASE WHEN feature = {chr(39)}{f}{chr(39)} THEN v END)', MONEY if f in EF_MONEY else 6)} AS {f}"
            for f in ENTITY_FEATURES) + " FROM cap GROUP BY entity_id"
    q["outlier_flags"] = with_(EF, FLAG_SCORES) + f"""SELECT entity_id, n_flags, {R('n_flags * 100.0 / 6')} AS total_pct FROM fl"""
    q["anomalous_entities"] = f"""WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT event_id AS entity_id, {R('CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END')} AS value
FROM events, b WHERE (CASE WHEN value < lo OR value > hi THEN 100.0 ELSE 0.0 END) > 50"""
    rr_stats = ", ".join(
        f"quantile_cont({f}, 0.25) AS a_{f}, quantile_cont({f}, 0.5) AS m_{f}, quantile_cont({f}, 0.75) AS b_{f}"
        for f in ENTITY_FEATURES)
    rr_cols = ", ".join(
        f"{R(f'CASE WHEN sc.score < -0.15 THEN ({f} - m_{f}) / CASE WHEN b_{f} - a_{f} = 0 THEN 1.0 ELSE b_{f} - a_{f} END ELSE {f} END', 4)} AS {f}"
        for f in ENTITY_FEATURES)
    q["robust_rescale_extremes"] = with_(EF, FLAG_SCORES) + f""", xs AS (SELECT {rr_stats} FROM ef JOIN sc USING (entity_id) WHERE sc.score < -0.15)
SELECT ef.entity_id, {rr_cols} FROM ef LEFT JOIN sc USING (entity_id), xs"""
    q["standardize"] = with_(EF, z_ef()) + "SELECT entity_id, " + ", ".join(f"{R(f)} AS {f}" for f in ENTITY_FEATURES) + " FROM z"

    q["segment_profiles"] = with_(EF, ef_long("acctbal n_orders total avg_total max_total n_status_f".split(), name="efl")) + \
        f""", seg AS (SELECT entity_id, segment FROM ef)
SELECT segment, feature, {R('avg(value)', MONEY)} AS mean FROM efl JOIN seg USING (entity_id) GROUP BY segment, feature"""
    q["segment_sizes"] = "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1"
    q["segment_region_counts"] = "SELECT c_mktsegment AS segment, c_nationkey AS region, count(*) AS n FROM customer GROUP BY 1, 2"
    q["multi_region_segments"] = """SELECT c_mktsegment AS segment, count(DISTINCT c_nationkey) AS n_regions FROM customer
WHERE c_nationkey IS NOT NULL GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1"""

    q["sampled_lookalikes"] = with_(EF) + """, multi AS (SELECT segment FROM ef WHERE region IS NOT NULL GROUP BY segment HAVING count(DISTINCT region) > 1),
s AS (SELECT entity_id, segment, region, name,
             row_number() OVER (PARTITION BY segment, region ORDER BY (entity_id * 7919) % 10007, entity_id) AS rk
      FROM ef WHERE segment IN (SELECT segment FROM multi))
SELECT a.segment, a.entity_id AS a_id, a.name AS a_name, a.region AS a_region, b.entity_id AS b_id, b.name AS b_name,
       b.region AS b_region
FROM s a JOIN s b ON a.segment = b.segment AND a.rk = b.rk AND a.region < b.region WHERE a.rk <= 10"""
    q["nearest_lookalikes"] = with_(VEC, D2_CTE) + f"SELECT segment, a_id, a_region, b_id, b_region, {R('similarity')} AS similarity FROM d2"
    q["precise_lookalikes"] = D3
    q["weight_features"] = with_(EF, z_ef({"acctbal": 2.0, "total": 0.5})) + "SELECT entity_id, " + ", ".join(
        f"{R(f)} AS {f}" for f in ENTITY_FEATURES) + " FROM z"
    q["similarity_summary"] = with_(EF, z_ef(), cos_pairs("a.region < b.region")) + f""", d3 AS (SELECT sim FROM ranked WHERE rn <= 10)
SELECT {R('avg(sim)')} AS mean_similarity, {R('min(sim)')} AS min_similarity, {R('max(sim)')} AS max_similarity,
       count(*) AS num_pairs FROM d3"""
    q["similarity_histogram"] = with_(VEC, D2_CTE, hist_sql("d2"))
    q["similarity_density"] = with_(VEC, D2_CTE, density_sql("d2"))

    q["select_by_cumulative"] = with_(VEC, var_shares()) + f""", c AS (SELECT feature, importance,
       sum(importance) OVER (ORDER BY importance DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative
       FROM imp)
SELECT feature, {R('importance')} AS importance, {R('cumulative')} AS cumulative FROM c WHERE cumulative - importance < 0.8"""
    q["explained_variance_cut"] = with_(VEC, var_shares()) + f""", c AS (SELECT CAST(substr(feature, 2) AS INTEGER) AS component,
       importance AS ratio FROM imp),
cc AS (SELECT component, ratio, sum(ratio) OVER (ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM c)
SELECT component, {R('ratio')} AS ratio, {R('cumulative')} AS cumulative FROM cc WHERE cumulative - ratio < 0.8"""
    q["inertia_curve"] = with_(VEC, HASH_LABELS, inertia_cte()) + f"SELECT k, {R('inertia', 4)} AS inertia FROM inertia"
    q["silhouette"] = with_(VEC, HASH_LABELS, silhouette_cte()) + f"SELECT k, {R('silhouette')} AS silhouette FROM sil"
    q["best_k_silhouette"] = with_(VEC, HASH_LABELS, silhouette_cte()) + f"SELECT k, {R('silhouette')} AS silhouette FROM sil ORDER BY silhouette DESC, k LIMIT 1"
    q["best_k_elbow"] = with_(VEC, HASH_LABELS, inertia_cte()) + f""", d AS (SELECT k, lag(inertia) OVER (ORDER BY k) - 2 * inertia + lead(inertia) OVER (ORDER BY k) AS d2 FROM inertia)
SELECT k, {R('d2', 4)} AS d2 FROM d WHERE d2 IS NOT NULL ORDER BY d2 DESC, k LIMIT 1"""
    q["best_cluster_count"] = f"""WITH s AS (SELECT CAST(k AS INTEGER) AS k, avg(CASE WHEN label = vec_id % k THEN 1.0 ELSE 0.0 END) AS score
  FROM embeddings, (VALUES (10), (11), (12)) ks(k) GROUP BY k)
SELECT k, {R('score')} AS score FROM s ORDER BY score DESC, k LIMIT 1"""
    rank_sql = """r AS (SELECT vec_id AS entity_id, label,
  row_number() OVER (PARTITION BY label ORDER BY (vec_id * 7919) % 10007, vec_id) AS rk,
  count(*) OVER (PARTITION BY label) AS n FROM embeddings)"""
    q["stratified_split"] = with_(rank_sql) + "SELECT entity_id, label, rk * 1000 <= n * 300 AS is_test FROM r"
    q["stratified_folds"] = with_(rank_sql) + "SELECT entity_id, label, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r"
    q["accuracy_f1"] = with_(PRED, per_class_cte()) + f"""SELECT {R('sum(tp) * 1.0 / sum(support)')} AS accuracy,
       {R('sum(f1 * support) / sum(support)')} AS f1_weighted FROM prf2"""
    q["classification_report"] = with_(PRED, per_class_cte()) + f"""SELECT CAST(cls AS VARCHAR) AS class, {R('precision')} AS precision, {R('recall')} AS recall,
       {R('f1')} AS f1, CAST(support AS BIGINT) AS support FROM prf2
UNION ALL SELECT 'accuracy', NULL, NULL, {R('sum(tp) * 1.0 / sum(support)')}, CAST(sum(support) AS BIGINT) FROM prf2
UNION ALL SELECT 'macro avg', {R('avg(precision)')}, {R('avg(recall)')}, {R('avg(f1)')}, CAST(sum(support) AS BIGINT) FROM prf2
UNION ALL SELECT 'weighted avg', {R('sum(precision * support) / sum(support)')}, {R('sum(recall * support) / sum(support)')},
       {R('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM prf2"""
    conf = """cls AS (SELECT label AS c FROM pred UNION SELECT prediction FROM pred),
cnt AS (SELECT label, prediction, count(*) AS n FROM pred GROUP BY 1, 2)"""
    q["confusion_matrix"] = with_(PRED, conf) + """SELECT a.c AS label, b.c AS prediction, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM cls a CROSS JOIN cls b LEFT JOIN cnt ON cnt.label = a.c AND cnt.prediction = b.c"""
    q["confusion_table"] = with_(PRED, conf) + """SELECT a.c + 1 AS label, b.c + 1 AS prediction, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
FROM cls a CROSS JOIN cls b LEFT JOIN cnt ON cnt.label = a.c AND cnt.prediction = b.c"""

    dim_case = "CASE feature " + " ".join(f"WHEN 'd{i}' THEN 'dimension {i}'" for i in range(8)) + " ELSE feature END"
    q["top_importances"] = with_(VEC, var_shares()) + f""", t AS (SELECT feature, importance, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp)
SELECT feature, {R('importance')} AS importance, rank, {dim_case} AS label FROM t WHERE rank <= 10"""
    q["correlation_triangle"] = with_(VEC, var_shares()) + f""", t AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp),
top AS (SELECT * FROM t WHERE rank <= 10),
w AS (SELECT vl.entity_id, top.feature, top.rank, vl.x FROM vl JOIN top ON top.feature = 'd' || CAST(vl.dim AS VARCHAR)),
pr AS (SELECT a.feature AS feature_a, b.feature AS feature_b, a.rank AS rank_a, b.rank AS rank_b,
              covar_samp(a.x, b.x) / nullif(stddev_samp(a.x) * stddev_samp(b.x), 0) AS r
       FROM w a JOIN w b ON a.entity_id = b.entity_id AND a.rank > b.rank GROUP BY 1, 2, 3, 4)
SELECT feature_a, feature_b, rank_a, rank_b, {R('r')} AS r FROM pr"""
    q["segment_map_table"] = with_(ASSIGN) + f"SELECT entity_id, region_code, segment FROM asg WHERE region_code IS NULL OR region_code NOT IN {EXCLUDED}"
    q["top_missing"] = with_(cells("month")) + f""", n AS (SELECT count(*) AS n FROM customer),
mp AS (SELECT feature, n.n - count(*) AS missing_count, (n.n - count(*)) * 100.0 / n.n AS missing_percent
       FROM cells, n GROUP BY feature, n.n HAVING n.n - count(*) > 0),
t AS (SELECT *, row_number() OVER (ORDER BY missing_count DESC, feature) AS rank FROM mp)
SELECT rank, feature, {R('missing_percent / 100.0')} AS missing_fraction,
       CASE feature WHEN 'm199501' THEN 'January 1995' ELSE feature END AS label FROM t WHERE rank <= 10"""
    q["profile_radar"] = with_(EF, ef_long()) + f""", seg AS (SELECT entity_id, segment FROM ef),
p AS (SELECT segment, feature, avg(value) AS mean FROM efl JOIN seg USING (entity_id) GROUP BY 1, 2),
sp AS (SELECT feature, var_samp(mean) AS spread, min(mean) AS lo, max(mean) AS hi FROM p GROUP BY feature),
t AS (SELECT *, row_number() OVER (ORDER BY spread DESC, feature) AS rank FROM sp)
SELECT t.rank, p.feature, p.segment, {R('p.mean', MONEY)} AS mean,
       {R('(p.mean - t.lo) / nullif(t.hi - t.lo, 0)')} AS normalized
FROM p JOIN t ON t.feature = p.feature WHERE t.rank <= 5"""
    q["outlier_map_table"] = with_(EF, FLAG_SCORES, ASSIGN) + f"""SELECT CAST(asg.entity_id AS BIGINT) AS entity_id, region_code, {R('sc.score')} AS score
FROM asg LEFT JOIN (SELECT * FROM sc WHERE score < 0) sc ON sc.entity_id = CAST(asg.entity_id AS BIGINT)
WHERE region_code IS NULL OR region_code NOT IN {EXCLUDED}"""
    q["knn_impute"] = with_(cells("status"), grid()) + f""", cnt AS (SELECT count(DISTINCT feature) AS d FROM grid),
miss AS (SELECT entity_id AS a_id, feature FROM grid WHERE value IS NULL),
inc AS (SELECT DISTINCT a_id FROM miss),
pr AS (SELECT a.entity_id AS a_id, b.entity_id AS b_id, sum((a.value - b.value) * (a.value - b.value)) AS ss,
              count(*) AS nb
       FROM grid a JOIN grid b ON a.feature = b.feature AND a.value IS NOT NULL AND b.value IS NOT NULL
       WHERE a.entity_id IN (SELECT a_id FROM inc) GROUP BY 1, 2),
dist AS (SELECT a_id, b_id, sqrt(ss * cnt.d / nb) AS dist FROM pr, cnt),
cand AS (SELECT m.a_id, m.feature, d.b_id, d.dist, g.value FROM miss m JOIN dist d ON d.a_id = m.a_id
         JOIN grid g ON g.entity_id = d.b_id AND g.feature = m.feature AND g.value IS NOT NULL),
top AS (SELECT *, row_number() OVER (PARTITION BY a_id, feature ORDER BY dist, b_id) AS rn FROM cand),
w AS (SELECT a_id, feature, max(CASE WHEN dist = 0 THEN 1 ELSE 0 END) AS z,
             avg(CASE WHEN dist = 0 THEN value END) AS zm,
             sum(CASE WHEN dist > 0 THEN value / dist END) / sum(CASE WHEN dist > 0 THEN 1.0 / dist END) AS wm
      FROM top WHERE rn <= 5 GROUP BY 1, 2),
means AS (SELECT feature, avg(value) AS m FROM grid GROUP BY feature)
SELECT m.a_id AS entity_id, m.feature, {R('coalesce(CASE WHEN w.z = 1 THEN w.zm ELSE w.wm END, means.m)', MONEY)} AS value
FROM miss m LEFT JOIN w ON w.a_id = m.a_id AND w.feature = m.feature LEFT JOIN means ON means.feature = m.feature"""
    gap = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in ENTITY_FEATURES)
    q["density_segments"] = f"""WITH RECURSIVE {EF}, {z_ef()},
near AS (SELECT a.entity_id AS a, b.entity_id AS b FROM z a JOIN z b ON sqrt({gap}) <= 0.6),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) >= 5),
link AS (SELECT a, b FROM near WHERE a <> b AND a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
reach AS (SELECT id AS node, id AS root FROM core
          UNION SELECT l.b, r.root FROM reach r JOIN link l ON l.a = r.node AND r.root < l.b),
lab AS (SELECT node, min(root) AS label FROM reach GROUP BY node),
edge AS (SELECT a, min(b) AS core FROM near WHERE a NOT IN (SELECT id FROM core) AND b IN (SELECT id FROM core) GROUP BY a)
SELECT z.entity_id, coalesce(lab.label, l2.label, -1) AS segment, lab.node IS NOT NULL AS is_core
FROM z LEFT JOIN lab ON lab.node = z.entity_id LEFT JOIN edge ON edge.a = z.entity_id
LEFT JOIN lab l2 ON l2.node = edge.core"""
    q["read_geojson"] = f"""SELECT c_custkey AS entity_id, c_mktsegment AS segment, {R('c_acctbal', MONEY)} AS x,
       {R('CAST(c_nationkey AS DOUBLE)')} AS y FROM customer"""
    q["write_geojson_lines"] = """SELECT '{"type":"Feature","properties":{"entity_id":' || c_custkey || ',"segment":"' || c_mktsegment
       || '"},"geometry":{"type":"Point","coordinates":[' || CAST(c_acctbal AS DOUBLE) || ',' || CAST(c_nationkey AS DOUBLE) || ']}}' AS value
       FROM customer"""
    q["run_summary"] = "SELECT CAST(6 AS BIGINT) AS n_input_features, CAST(count(*) AS BIGINT) AS n_rows FROM customer"
    q["ingest_gzip_text"] = "SELECT trim(unnest(string_split(text, chr(10)))) AS value FROM documents"
    return q
