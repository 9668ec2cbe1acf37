"""Queries over density clustering: a grid of settings held against known persons, and clusters by hierarchy; they register with those of ``queries``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnmark.operators import density as D
from cairnmark.plans.queries import _DIST, _UNIT, _faces, query, unexpressed

GRID_EPS, GRID_LEAST = (0.55, 0.65), (2, 3)
SIZES, EPSILONS = (3, 5), (0.0, 0.6)


def _flat_sql(k: int, eps: float, least: int) -> str:
    return f"""e{k} AS MATERIALIZED (SELECT a, b FROM pairs WHERE d <= {eps}), core{k} AS MATERIALIZED (SELECT u.id FROM u LEFT JOIN e{k} e ON e.a = u.id GROUP BY u.id HAVING count(e.b) + 1 >= {least}),
      reach{k} AS (SELECT id AS node, id AS root FROM core{k} UNION SELECT e.b, r.root FROM reach{k} r JOIN e{k} e ON e.a = r.node JOIN core{k} c ON c.id = e.b), roots{k} AS (SELECT node, min(root) AS root FROM reach{k} GROUP BY node),
      m{k} AS (SELECT CAST({eps} AS DOUBLE) AS eps, {least} AS least, u.id, coalesce(r.root, (SELECT min(x.root) FROM e{k} e JOIN roots{k} x ON x.node = e.b WHERE e.a = u.id)) AS label FROM u LEFT JOIN roots{k} r ON r.node = u.id)"""


_SETTINGS = [(eps, least) for least in GRID_LEAST for eps in GRID_EPS]
_RAND = """SELECT eps, least, CASE WHEN (t + l) / 2 = t * l / pairs THEN 1.0 ELSE (x - t * l / pairs) / ((t + l) / 2 - t * l / pairs) END AS ari
    FROM (SELECT eps, least, sum(n * (n - 1) / 2) AS x, sum(n) * (sum(n) - 1) / 2 AS pairs FROM {cells} GROUP BY 1, 2) JOIN (SELECT eps, least, sum(n * (n - 1) / 2) AS t FROM (SELECT eps, least, truth, sum(n) AS n FROM {cells} GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (eps, least)
    JOIN (SELECT eps, least, sum(n * (n - 1) / 2) AS l FROM (SELECT eps, least, label, sum(n) AS n FROM {cells} GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (eps, least)"""


@query(
    f"""WITH RECURSIVE u AS MATERIALIZED {_UNIT}, pairs AS MATERIALIZED (SELECT a.id AS a, b.id AS b, {_DIST} AS d FROM u a JOIN u b ON a.id <> b.id AND {_DIST} <= {max(GRID_EPS)}), {", ".join(_flat_sql(k, *s) for k, s in enumerate(_SETTINGS))},
    cells AS MATERIALIZED (SELECT eps, least, label, e.label AS truth, count(*) AS n FROM ({" UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(len(_SETTINGS)))}) m JOIN embeddings e ON e.vec_id = m.id GROUP BY m.eps, m.least, m.label, e.label), inner_cells AS (SELECT * FROM cells WHERE label IS NOT NULL)
    SELECT c.eps, c.least, round(a.ari, 6) AS ari, round(i.ari, 6) AS ari_clustered, count(DISTINCT c.label) AS n_clusters, sum(CASE WHEN c.label IS NULL THEN n ELSE 0 END) AS n_noise,
      (SELECT coalesce(sum(s - m), 0) FROM (SELECT sum(n) AS s, max(n) AS m FROM inner_cells x WHERE x.eps = c.eps AND x.least = c.least GROUP BY label)) AS n_reassign, sum(CASE WHEN c.label IS NULL THEN n ELSE 0 END) AS n_unassigned
    FROM cells c JOIN ({_RAND.format(cells="cells")}) a ON a.eps = c.eps AND a.least = c.least LEFT JOIN ({_RAND.format(cells="inner_cells")}) i ON i.eps = c.eps AND i.least = c.least GROUP BY c.eps, c.least, a.ari, i.ari""".replace("label, e.label AS truth", "m.label, e.label AS truth")
)
def flat_grid(c):
    found = D.flat_clusters(_faces(c).select("id", "embedding"), _SETTINGS)
    named = reduce(lambda at, k: at.when(F.col("setting") == k, F.struct(F.lit(_SETTINGS[k][0]).alias("eps"), F.lit(_SETTINGS[k][1]).alias("least"))), range(len(_SETTINGS)), F)
    return D.agreement(found.withColumn("of", named).select("of.eps", "of.least", "id", "label"), _truth(c), "eps", "least")


def _truth(c) -> DataFrame:
    return c.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("truth"))


@unexpressed
def hierarchy_labels(c):
    return D.hierarchy(_faces(c).select("id", "embedding"), 3).select("id", "label")


@unexpressed
def hierarchy_grid(c):
    return D.agreement(D.hierarchies(_faces(c).select("id", "embedding"), list(SIZES), list(EPSILONS)), _truth(c), "epsilon", "least")
