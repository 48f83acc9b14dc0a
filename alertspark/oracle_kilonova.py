"""DuckDB statements of the kilonova and rise features and of the labels from an object's next alert."""

from __future__ import annotations

import math

D = "::DOUBLE"
FLUX = ("flux_peak", "snr_max", "snr_mean")
TEMPLATE = [f"tpl{j}_{k}" for j in range(3) for k in ("coef", "shift", "cos")]
COLOUR = ("n_colour", "colour_mean", "colour_first", "colour_last", "colour_rate")


def _templates() -> str:
    """Daily values of the three templates: exp(-d/2), exp(-d/8), (d/5) exp(1 - d/5)."""
    rows = [(j, d, f(d)) for j, f in enumerate((lambda d: math.exp(-d / 2), lambda d: math.exp(-d / 8), lambda d: d / 5 * math.exp(1 - d / 5))) for d in range(40)]
    return ", ".join(f"({j}, {d}, {v!r}{D})" for j, d, v in rows)


def features(lc: str) -> str:
    """CTEs behind ``lc`` that end in ``kt`` (candid, band, ...) and ``colour`` (candid, ...): points as rows, no arrays."""
    return lc + f""",
pts AS MATERIALIZED (
  SELECT candid, i, cjd[i] AS t, cmagpsf[i] AS m, csigmapsf[i] AS e, cfid[i] AS band
  FROM (SELECT *, unnest(range(1, len(cjd) + 1)) AS i FROM lc) WHERE cmagpsf[i] IS NOT NULL
),
fl AS MATERIALIZED (
  SELECT *, CAST(floor(t - first_value(t) OVER w) AS INTEGER) AS day, power(10.0{D}, -0.4{D} * (m - 25.0{D})) AS y,
    1.0{D} / (0.4{D} * ln(10.0{D}) * e) AS snr
  FROM pts WINDOW w AS (PARTITION BY candid, band ORDER BY i)
),
rel AS MATERIALIZED (SELECT *, y / max(y) OVER (PARTITION BY candid, band) AS z FROM fl),
base AS (SELECT candid, band, max(y) AS flux_peak, max(snr) AS snr_max, avg(snr) AS snr_mean, sum(z * z) AS own FROM rel GROUP BY ALL),
tpl AS (SELECT * FROM (VALUES {_templates()}) v(j, d, x)),
proj AS (
  SELECT candid, band, j, s, sum(z * x) AS dot, sum(x * x) AS norm
  FROM (SELECT candid, band, z, j, s, coalesce(x, 0.0{D}) AS x FROM rel CROSS JOIN range(3) a(j) CROSS JOIN range(8) b(s) LEFT JOIN tpl USING (j) WHERE tpl.d = day + s
        UNION ALL SELECT candid, band, z, j, s, 0.0{D} FROM rel CROSS JOIN range(3) a(j) CROSS JOIN range(8) b(s) WHERE day + s >= 40)
  GROUP BY ALL
),
best AS (SELECT * FROM proj QUALIFY row_number() OVER (PARTITION BY candid, band, j ORDER BY coalesce(round(CASE WHEN norm <> 0 THEN dot / sqrt(norm) END, 9), 0) DESC, s) = 1),
kt AS MATERIALIZED (
  SELECT b.candid, b.band, any_value(flux_peak) AS flux_peak, any_value(snr_max) AS snr_max, any_value(snr_mean) AS snr_mean,
    {", ".join(f"max(CASE WHEN j = {j} AND norm <> 0 THEN dot / norm END) AS tpl{j}_coef, max(CASE WHEN j = {j} THEN s END) AS tpl{j}_shift, max(CASE WHEN j = {j} AND norm * own <> 0 THEN dot / sqrt(norm * own) END) AS tpl{j}_cos" for j in range(3))}
  FROM base b JOIN best USING (candid, band) GROUP BY b.candid, b.band
),
r AS (SELECT candid, t, max(m) AS m FROM pts WHERE band = 2 GROUP BY candid, t),
col AS MATERIALIZED (
  SELECT g.candid, g.t, g.i, g.m, g.m - r.m AS c FROM (SELECT * FROM pts WHERE band = 1) g ASOF JOIN r ON g.candid = r.candid AND g.t >= r.t
  WHERE g.t - r.t <= 0.5{D}
),
colour AS (
  SELECT candid, CAST(count(*) AS INTEGER) AS n_colour, avg(c) AS colour_mean, min_by(c, (t, m)) AS colour_first, max_by(c, (t, m)) AS colour_last,
    CASE WHEN max(t) <> min(t) THEN (max_by(c, (t, m)) - min_by(c, (t, m))) / (max(t) - min(t)) END AS colour_rate
  FROM col GROUP BY candid
)"""


def rise(lc: str) -> str:
    """CTEs behind ``lc`` that end in ``rise`` (candid, band, status, n_rise, a, b, c, chi2): the regression of the logit on the way up."""
    return lc + f""",
upts AS MATERIALIZED (
  SELECT candid, i, cjd[i] AS t, cmagpsf[i] AS m, csigmapsf[i] AS e, cfid[i] AS band
  FROM (SELECT *, unnest(range(1, len(cjd) + 1)) AS i FROM lc) WHERE cmagpsf[i] IS NOT NULL AND csigmapsf[i] > 0
),
way AS MATERIALIZED (
  SELECT candid, band, t - t0 AS t, power(10.0{D}, -0.4{D} * (m - 25.0{D})) AS y, 0.4{D} * ln(10.0{D}) * e * power(10.0{D}, -0.4{D} * (m - 25.0{D})) AS s
  FROM (SELECT *, min(t) OVER (PARTITION BY candid, band) AS t0, first_value(i) OVER (PARTITION BY candid, band ORDER BY m, i) AS top FROM upts) WHERE i <= top
),
lg AS MATERIALIZED (
  SELECT *, ln(y / (c - y)) AS z, power(y * (c - y) / (c * s), 2) AS w FROM (SELECT *, 1.1{D} * max(y) OVER (PARTITION BY candid, band) AS c FROM way)
),
mean AS (SELECT candid, band, count(*) AS n, max(c) AS c, sum(w) AS w, sum(w * t) / sum(w) AS mt, sum(w * z) / sum(w) AS mz FROM lg GROUP BY ALL),
line AS (
  SELECT m.candid, m.band, m.n, m.c, m.mt, m.mz, m.w, sum(l.w * power(l.t - m.mt, 2)) AS tt, sum(l.w * (l.t - m.mt) * (l.z - m.mz)) AS tz
  FROM mean m JOIN lg l USING (candid, band) GROUP BY ALL
),
ab AS (
  SELECT *, mt - mz / a AS b, CASE WHEN n < 3 OR a IS NULL THEN 'too_few' WHEN a <= 0 THEN 'not_rising' ELSE 'ok' END AS status
  FROM (SELECT *, CASE WHEN tt > 1e-9 * w THEN tz / tt END AS a FROM line)
),
rise AS (
  SELECT ab.candid, ab.band, status, n, a, b, ab.c, sum(power((y - ab.c / (1 + exp(-a * (t - b)))) / s, 2)) AS chi2
  FROM ab JOIN lg ON lg.candid = ab.candid AND lg.band = ab.band GROUP BY ALL
)"""


def add(q: dict[str, str], w, flat: str, alerts: str, curve_sql, curve: list[str]) -> None:
    curves = curve_sql("lc", "candid", "cjd", "cmagpsf", "csigmapsf", "cfid", [1, 2], "lower")
    six = lambda names, t: ", ".join(f"round({t}.{n}, 6) AS {n}" if not n.endswith("shift") else f"{t}.{n}" for n in names)
    q["kn_features"] = w(features(alerts), curves) + f"""
SELECT c.candid, CAST(c.band AS VARCHAR) AS band, {", ".join(f"c.{k}" for k in curve)}, round(k.flux_peak, 3) AS flux_peak, {six(("snr_max", "snr_mean", *TEMPLATE), "k")},
  coalesce(o.n_colour, 0) AS n_colour, {six(COLOUR[1:], "o")}
FROM curve c LEFT JOIN kt k ON k.candid = c.candid AND k.band = c.band LEFT JOIN colour o ON o.candid = c.candid"""
    shown = ", ".join(f"CASE WHEN r.status = 'ok' THEN round(r.{k}, {d}) END AS rise_{k}" for k, d in (("a", 6), ("b", 4), ("c", 3), ("chi2", 2)))
    q["snia_features"] = w(rise(alerts), curves) + f"""
SELECT c.candid, CAST(c.band AS VARCHAR) AS band, {", ".join(f"c.{k}" for k in curve)}, coalesce(r.status, 'too_few') AS rise_status,
  CAST(coalesce(r.n, 0) AS INTEGER) AS n_rise, {shown}
FROM curve c LEFT JOIN rise r ON r.candid = c.candid AND r.band = c.band"""
    q["next_alert_label"] = w(flat) + """
SELECT candid, CASE WHEN next IS NOT NULL THEN CAST(next = 'purchase' AS DOUBLE) END AS label
FROM (SELECT candid, lead(event_type) OVER (PARTITION BY objectId ORDER BY us, candid) AS next FROM flat)"""
