"""DuckDB SQL for the queries: each text computes everything from the tables."""

from __future__ import annotations

from farpoint.functions.erf import erf_sql
from farpoint.functions.metrics import METRICS, euclidean_sq

CUSTOMER = "SELECT CAST(c_custkey AS BIGINT) AS id, CAST(c_acctbal AS DOUBLE) AS f0, c_mktsegment AS cluster FROM customer"
SUPPLIER = "SELECT CAST(s_suppkey AS BIGINT) AS id, CAST(s_acctbal AS DOUBLE) AS f0, 0 AS cluster FROM supplier"
PART = "SELECT CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS DOUBLE) AS f0, CAST(p_retailprice AS DOUBLE) AS f1, p_brand AS cluster FROM part"
SCALED = (
    "SELECT id, cluster, CASE WHEN sd0 = 0 THEN 0e0 ELSE (f0 - m0) / sd0 END AS f0, CASE WHEN sd1 = 0 THEN 0e0 ELSE (f1 - m1) / sd1 END AS f1 FROM "
    "(SELECT *, avg(f0) OVER w AS m0, stddev_pop(f0) OVER w AS sd0, avg(f1) OVER w AS m1, stddev_pop(f1) OVER w AS sd1 "
    f"FROM ({PART}) WINDOW w AS (PARTITION BY cluster))"
)
VECTORS = "SELECT CAST(vec_id AS BIGINT) AS id, label AS cluster, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64)) + " FROM embeddings"


def r6(name: str) -> str:
    return f"round({name}, 6) + 0e0 AS {name}"


def edges_cte(points: str, width: int, k: int, metric: str = "euclidean", name: str = "e") -> str:
    a, b = [f"a.f{i}" for i in range(width)], [f"b.f{i}" for i in range(width)]
    d2 = euclidean_sq(a, b) if metric == "euclidean" else f"({METRICS[metric](a, b)}) * ({METRICS[metric](a, b)})"
    return (
        f"p AS ({points}), pr AS (SELECT a.id, a.cluster, b.id AS nid, {d2} AS d2 FROM p a JOIN p b ON a.cluster = b.cluster AND a.id <> b.id), "
        f"rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS rank FROM pr), {name} AS (SELECT * FROM rk WHERE rank <= {k})"
    )


def score_cte(k: int, extent: int, e: str = "e", tag: str = "") -> str:
    """Stages from edges ``e`` to ``s{tag}``: the wide scores."""
    q = lambda n: f"{n}{tag}"
    return (
        f"{q('sd')} AS (SELECT id, any_value(cluster) AS cluster, sum(d2) AS ssd, sqrt(sum(d2) / {k}) AS std_dist, {extent}e0 * sqrt(sum(d2) / {k}) AS pdist FROM {e} GROUP BY id), "
        f"{q('ex')} AS (SELECT {e}.id, coalesce(avg(n.pdist) FILTER (WHERE NOT isnan(n.pdist)), 'NaN'::DOUBLE) AS ev FROM {e} JOIN {q('sd')} n ON n.id = {e}.nid GROUP BY {e}.id), "
        f"{q('bs')} AS (SELECT {q('sd')}.*, ev FROM {q('sd')} JOIN {q('ex')} USING (id)), "
        f"{q('g1')} AS (SELECT bool_and(pdist = ev AND NOT isnan(pdist)) AS lv FROM {q('bs')}), "
        f"{q('pl')} AS (SELECT b.*, CASE WHEN lv THEN 0e0 ELSE pdist / (CASE WHEN ev = 0 THEN 1e-8 ELSE ev END) - 1e0 END AS plof FROM {q('bs')} b, {q('g1')}), "
        f"{q('pe')} AS (SELECT cluster AS c, coalesce(avg(plof * plof) FILTER (WHERE NOT isnan(plof)), 'NaN'::DOUBLE) AS plof_ev FROM {q('pl')} GROUP BY cluster), "
        f"{q('np')} AS (SELECT x.*, plof_ev, {extent}e0 * sqrt(plof_ev) AS nplof FROM {q('pl')} x JOIN {q('pe')} ON x.cluster = c), "
        f"{q('g2')} AS (SELECT bool_and(plof = nplof AND NOT isnan(plof)) AS lv FROM {q('np')}), "
        f"{q('yy')} AS (SELECT n.*, lv, CASE WHEN isnan(plof) OR isnan(nplof) THEN 'NaN'::DOUBLE WHEN nplof <> 0 THEN greatest(0e0, plof / (nplof * sqrt(2e0))) "
        f"WHEN plof > 0 THEN 'Infinity'::DOUBLE WHEN plof < 0 THEN 0e0 ELSE 'NaN'::DOUBLE END AS y FROM {q('np')} n, {q('g2')}), "
        f"{q('s')} AS (SELECT *, CASE WHEN lv THEN 0e0 ELSE {erf_sql('y')} END AS score FROM {q('yy')})"
    )


def scored(points: str, width: int, k: int, select: str, extent: int = 3, metric: str = "euclidean", tail: str = "FROM s") -> str:
    return f"WITH {edges_cte(points, width, k, metric)}, {score_cte(k, extent)} SELECT {select} {tail}"


GLOBAL = CUSTOMER.replace("c_mktsegment AS cluster", "0 AS cluster")
TRAIN = f"{GLOBAL} WHERE c_custkey % 5 <> 0"
#: Neighbours over all customers, then clusters by segment.
MATRIX = edges_cte(GLOBAL, 1, 10, name="e0") + ", seg AS (SELECT CAST(c_custkey AS BIGINT) AS id, c_mktsegment AS cluster FROM customer)"


def new_rows(ssd: str, k: int = 10) -> str:
    """Scores of new rows (id, ssd) against the model in ``s``."""
    return (
        f"m AS (SELECT avg(ev) AS me, max(nplof) AS mn FROM s), nw AS ({ssd}), "
        f"n1 AS (SELECT id, CASE WHEN 3e0 * sqrt(ssd / {k}) = me THEN 0e0 ELSE 3e0 * sqrt(ssd / {k}) / (CASE WHEN me = 0 THEN 1e-8 ELSE me END) - 1e0 END AS plof, mn FROM nw, m), "
        f"n2 AS (SELECT *, greatest(0e0, plof / (mn * sqrt(2e0))) AS y FROM n1), ns AS (SELECT id, CASE WHEN plof = mn THEN 0e0 ELSE {erf_sql('y')} END AS score FROM n2)"
    )


NEW_SSD = (
    "SELECT id, sum(d2) AS ssd FROM (SELECT q.c_custkey AS id, (q.c_acctbal - p.f0) * (q.c_acctbal - p.f0) AS d2, row_number() OVER "
    "(PARTITION BY q.c_custkey ORDER BY (q.c_acctbal - p.f0) * (q.c_acctbal - p.f0)) AS r FROM customer q, p WHERE q.c_custkey % 5 = 0) WHERE r <= 10 GROUP BY id"
)


def oracle_sql() -> dict[str, str]:
    edge_cols = f"id, nid, rank, {r6('d2')}"
    out = {
        "pairwise_distance": f"WITH p AS ({SUPPLIER}) SELECT a.id, b.id AS nid, round({METRICS['euclidean'](['a.f0'], ['b.f0'])}, 6) + 0e0 AS dist FROM p a JOIN p b ON a.id < b.id",
        "knn_edges": f"WITH {edges_cte(CUSTOMER, 1, 10)} SELECT {edge_cols} FROM e",
        "knn_edges_block": f"WITH {edges_cte(CUSTOMER, 1, 10)} SELECT {edge_cols} FROM e",
        "knn_edges_block_2d": f"WITH {edges_cte(PART, 2, 5)} SELECT {edge_cols} FROM e",
        "knn_edges_global": f"WITH {edges_cte(SUPPLIER, 1, 10)} SELECT {edge_cols} FROM e",
        "loop_wide": scored(CUSTOMER, 1, 10, "id, " + ", ".join(map(r6, ("ssd", "std_dist", "pdist", "ev", "plof", "plof_ev", "nplof", "score")))),
        "loop_clustered": scored(CUSTOMER, 1, 10, f"id, cluster, {r6('score')}"),
        "loop_global": scored(SUPPLIER, 1, 10, f"id, {r6('score')}"),
        "loop_multifeature": scored(SCALED, 2, 10, f"id, {r6('score')}"),
        "loop_embeddings": scored(VECTORS, 64, 10, f"id, {r6('score')}"),
        "loop_duplicates": scored("SELECT CAST(s_suppkey AS BIGINT) AS id, 1e0 AS f0, 0 AS cluster FROM supplier", 1, 3, f"id, {r6('score')}"),
        "loop_near_duplicates": scored("SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 7 = 0 THEN s_acctbal ELSE 0e0 END AS f0, 0 AS cluster FROM supplier", 1, 3, f"id, {r6('pdist')}, {r6('ev')}, {r6('score')}"),
        "loop_matrix_cross_cluster": f"WITH {MATRIX}, e AS (SELECT e0.id, seg.cluster, nid, d2 FROM e0 JOIN seg USING (id)), {score_cte(10, 3)} SELECT id, {r6('score')} FROM s",
        "loop_matrix_nan": f"WITH {MATRIX}, e AS (SELECT e0.id, seg.cluster, nid, CASE WHEN e0.id % 50 = 0 THEN 'NaN'::DOUBLE ELSE d2 END AS d2 FROM e0 JOIN seg USING (id)), {score_cte(10, 3)} SELECT id, CASE WHEN NOT isnan(score) THEN round(score, 6) + 0e0 END AS score FROM s",
        "model_stats": scored(CUSTOMER, 1, 10, "round(max(nplof), 6) + 0e0 AS max_nplof, round(avg(ev), 6) + 0e0 AS mean_ev, count(*) AS rows"),
        "outlier_filter": scored(CUSTOMER, 1, 10, f"id, {r6('score')}", tail="FROM s WHERE score > 0.1 AND NOT isnan(score)"),
        "outlier_topk": scored(CUSTOMER, 1, 10, f"id, {r6('score')}", tail="FROM s ORDER BY round(s.score, 6) DESC, id LIMIT 20"),
        "attach_scores": scored(SUPPLIER, 1, 10, f"s_suppkey, s_name, {r6('score')}", tail="FROM supplier LEFT JOIN s ON s.id = s_suppkey"),
        "stream_score": f"WITH {edges_cte(TRAIN, 1, 10)}, {score_cte(10, 3)}, {new_rows(NEW_SSD)} SELECT id, {r6('score')} FROM ns",
        "concat_scores": f"WITH {edges_cte(TRAIN, 1, 10)}, {score_cte(10, 3)}, {new_rows(NEW_SSD)} SELECT id, {r6('score')}, false AS is_new FROM s UNION ALL SELECT id, {r6('score')}, true AS is_new FROM ns",
        "stream_score_distance": f"WITH {edges_cte(GLOBAL, 1, 10)}, {score_cte(10, 3)}, {new_rows('SELECT c_custkey AS id, 10e0 * (abs(c_acctbal) / 1000) * (abs(c_acctbal) / 1000) AS ssd FROM customer')} SELECT id, {r6('score')} FROM ns",
        "loop_k_ensemble": f"WITH {edges_cte(CUSTOMER, 1, 20)}, " + ", ".join(f"e{k} AS (SELECT * FROM e WHERE rank <= {k}), {score_cte(k, 3, f'e{k}', str(k))}" for k in (5, 10, 20))
        + " SELECT id, round(avg(score), 6) + 0e0 AS score FROM (" + " UNION ALL ".join(f"SELECT id, score FROM s{k}" for k in (5, 10, 20)) + ") GROUP BY id",
        "loop_extents": f"WITH {edges_cte(CUSTOMER, 1, 10)}, " + ", ".join(score_cte(10, x, "e", f"x{x}") for x in (1, 2, 3))
        + " " + " UNION ALL ".join(f"SELECT CAST({x} AS BIGINT) AS extent, id, {r6('score')} FROM sx{x}" for x in (1, 2, 3)),
        "cluster_sizes": "SELECT event_type AS cluster, count(*) AS n FROM events GROUP BY event_type",
        "missing_counts": "SELECT count(*) FILTER (WHERE value IS NULL OR isnan(value)) AS f0 FROM events",
    }
    batch = f"SELECT * FROM (WITH {edges_cte(GLOBAL, 1, 10)}, {score_cte(10, 3)} SELECT id AS bid, score AS b FROM s)"
    out["stream_vs_batch_rmse"] = f"WITH {edges_cte(TRAIN, 1, 10)}, {score_cte(10, 3)}, {new_rows(NEW_SSD)}, ba AS ({batch}) SELECT round(sqrt(avg((score - b) * (score - b))), 6) + 0e0 AS rmse FROM ns JOIN ba ON bid = id"
    for name, col in (("sum_squared_distance", "ssd"), ("standard_distance", "std_dist"), ("prob_distance", "pdist"), ("expected_prob_distance", "ev"), ("plof", "plof"), ("plof_ev", "plof_ev"), ("nplof", "nplof")):
        out[name] = scored(CUSTOMER, 1, 10, f"id, {r6(col)}")
    for m in ("manhattan", "chebyshev", "canberra", "braycurtis", "hamming", "cosine"):
        out[f"loop_metric_{m}"] = scored(PART, 2, 10, f"id, {r6('score')}", metric=m)
    out["structured_stream_score"] = out["stream_score"]
    # all pairs of events are too many for SQL; neighbours in sorted order lie within k places
    near = (
        "o AS (SELECT event_id AS id, value AS x, row_number() OVER (ORDER BY value, event_id) AS r FROM events), "
        "w AS (SELECT a.id, 0 AS cluster, b.id AS nid, (a.x - b.x) * (a.x - b.x) AS d2 FROM o a JOIN (SELECT unnest(range(-40, 41)) AS off) f ON f.off <> 0 JOIN o b ON b.r = a.r + f.off), "
        "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS rank FROM w) WHERE rank <= 10)"
    )
    out["score_auc"] = (
        f"WITH {near}, {score_cte(10, 3)}, j AS (SELECT round(score, 9) AS sc, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS y FROM s JOIN events ON event_id = id), "
        "g AS (SELECT sc, sum(y) AS p, sum(1 - y) AS n FROM j GROUP BY sc), h AS (SELECT *, coalesce(sum(n) OVER (ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bl FROM g) "
        "SELECT round(CAST(sum(p * (bl + n / 2e0)) AS DOUBLE) / CAST(sum(p) * sum(n) AS DOUBLE), 4) + 0e0 AS auc FROM h"
    )
    return out
