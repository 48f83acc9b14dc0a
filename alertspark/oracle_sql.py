"""Independent SQL (DuckDB dialect) for the registered queries.

Each string rebuilds the alert-shaped fixtures from the raw driver tables with
plain SQL (self-contained CTEs, no Spark code shared) and computes the same
result columns as the Spark query of the same key.
"""

from __future__ import annotations

from alertspark import oracle_kilonova, oracle_sso

D = "::DOUBLE"

# Flat alerts from events (same expressions as alertspark.sources.fixtures.flat_alerts).
FLAT = f"""
ev AS (
  SELECT *, epoch_us(ts) AS us,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events
),
flat AS (
  SELECT
    'OBJ' || CAST(user_id AS VARCHAR) AS objectId,
    event_id AS candid, user_id, event_type, value, us, ts,
    us / 8.64e10{D} + 2440587.5{D} AS jd,
    CAST(event_id % 2 + 1 AS INTEGER) AS fid,
    CASE WHEN event_type <> 'error' THEN 15.0{D} + value / 100.0{D} END AS magpsf,
    CASE WHEN event_type <> 'error' THEN 0.02{D} + 0.001{D} * (event_id % 50) END AS sigmapsf,
    20.0{D} + CAST(event_id % 10 AS DOUBLE) / 10.0{D} AS diffmaglim,
    16.0{D} + CAST(user_id % 40 AS DOUBLE) / 10.0{D} AS magnr,
    0.03{D} AS sigmagnr,
    CASE WHEN event_id % 3 <> 0 THEN 't' ELSE 'f' END AS isdiffpos,
    CAST(event_id % 30 AS DOUBLE) / 20.0{D} AS distnr,
    CAST(k AS DOUBLE) / 100.0{D} AS sgscore1,
    CASE WHEN k >= 50 THEN -999.0{D} ELSE CAST(k AS DOUBLE) / 4.0{D} END AS ssdistnr,
    CAST(event_id % 40 AS DOUBLE) / 4.0{D} AS distpsnr1,
    fmod(CAST(user_id AS DOUBLE) * 137.50776405{D}, 360.0{D}) AS ra,
    fmod(CAST(user_id AS DOUBLE) * 0.618034{D}, 1.0{D}) * 120.0{D} - 60.0{D}
      + CAST(event_id % 8 AS DOUBLE) * 0.4{D} / 3600.0{D} AS dec,
    CAST(year(ts) AS INTEGER) AS year,
    CAST(month(ts) AS INTEGER) AS month,
    CAST(day(ts) AS INTEGER) AS day
  FROM ev
)"""

# Alerts with history (30-day range window) and running detection count.
ALERTS = FLAT + """,
alerts AS (
  SELECT f.*,
    list_sort(coalesce(list(struct_pack(jd := jd, candid := candid, fid := fid, magpsf := magpsf,
         sigmapsf := sigmapsf, diffmaglim := diffmaglim, magnr := magnr, sigmagnr := sigmagnr,
         isdiffpos := isdiffpos, distnr := distnr)) OVER hw, [])) AS prv,
    CAST(count(magpsf) OVER uw AS INTEGER) AS ndethist,
    min(CASE WHEN magpsf IS NOT NULL THEN jd END) OVER uw AS jdstarthist
  FROM flat f
  WINDOW hw AS (PARTITION BY objectId ORDER BY us RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING),
         uw AS (PARTITION BY objectId ORDER BY us RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
lc AS (
  SELECT a.*,
    list_concat(list_transform(prv, lambda x: x.jd), [jd]) AS cjd,
    list_concat(list_transform(prv, lambda x: x.magpsf), [magpsf]) AS cmagpsf,
    list_concat(list_transform(prv, lambda x: x.sigmapsf), [sigmapsf]) AS csigmapsf,
    list_concat(list_transform(prv, lambda x: x.fid), [fid]) AS cfid,
    list_concat(list_transform(prv, lambda x: x.magnr), [magnr]) AS cmagnr,
    list_concat(list_transform(prv, lambda x: x.sigmagnr), [sigmagnr]) AS csigmagnr,
    list_concat(list_transform(prv, lambda x: x.isdiffpos), [isdiffpos]) AS cisdiffpos,
    list_concat(list_transform(prv, lambda x: x.diffmaglim), [diffmaglim]) AS cdiffmaglim,
    list_concat(list_transform(prv, lambda x: x.distnr), [distnr]) AS cdistnr
  FROM alerts a
)"""


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip().lstrip(",") for c in ctes)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}

    q["asteroid_flag"] = w(ALERTS) + """
SELECT candid,
  CAST(CASE
    WHEN ssdistnr >= 0.0 AND ssdistnr < 5.0 THEN 3
    WHEN ndethist = 2 AND NOT (sgscore1 > 0.76 AND distpsnr1 < 1.0)
         AND (CASE WHEN len(dj) >= 2 THEN dj[-1] - dj[-2] END) <= 1.0 THEN 2
    WHEN ndethist = 1 AND NOT (sgscore1 > 0.76 AND distpsnr1 < 1.0) THEN 1
    ELSE 0 END AS INTEGER) AS roid
FROM (SELECT *, list_filter(cjd, lambda x, i: cmagpsf[i] IS NOT NULL) AS dj FROM lc)
"""
    _sources(q)
    _lightcurves(q)
    _xmatch(q)
    _features(q)
    _rates_reports(q)
    _stamps(q)
    _supervised(q)
    _sso_user(q)
    oracle_sso.add(q, FLAT)
    oracle_kilonova.add(q, w, FLAT, ALERTS, _curve_sql, CURVE)
    _checks(q)
    return q


RUBIN = FLAT + f""",
rflat AS (
  SELECT *, jd - 2400000.5{D} AS midPointTai,
    value * 100.0{D} - 500.0{D} AS psFlux,
    10.0{D} + CAST(candid % 50 AS DOUBLE) AS psFluxErr,
    substr('ugrizY', CAST(candid % 6 + 1 AS INTEGER), 1) AS filterName,
    CAST(user_id % 100 AS DOUBLE) / 100.0{D} AS hostgal_zphot,
    0.01{D} + CAST(user_id % 10 AS DOUBLE) / 100.0{D} AS hostgal_zphot_err,
    CAST(candid % 20 AS DOUBLE) / 10.0{D} AS hostgal_snsep,
    CAST(user_id % 30 AS DOUBLE) / 100.0{D} AS mwebv
  FROM flat
),
rubin AS (
  SELECT r.*,
    list_sort(coalesce(list(struct_pack(midPointTai := midPointTai, candid := candid, psFlux := psFlux,
        psFluxErr := psFluxErr, filterName := filterName)) OVER hw, [])) AS prv
  FROM rflat r
  WINDOW hw AS (PARTITION BY objectId ORDER BY us RANGE BETWEEN 2592000000000 PRECEDING AND 1 PRECEDING)
),
rlc AS (
  SELECT candid AS alertId, *,
    list_concat(list_transform(prv, lambda x: x.midPointTai), [midPointTai]) AS cmidPointTai,
    list_concat(list_transform(prv, lambda x: x.psFlux), [psFlux]) AS cpsFlux,
    list_concat(list_transform(prv, lambda x: x.psFluxErr), [psFluxErr]) AS cpsFluxErr,
    list_concat(list_transform(prv, lambda x: x.filterName), [filterName]) AS cfilterName
  FROM rubin
)"""


def catalog_cte(name: str) -> str:
    pos = f"""p_partkey AS source_id,
    fmod(CAST(p_partkey AS DOUBLE) * 137.50776405{D}, 360.0{D}) AS ra,
    fmod(CAST(p_partkey AS DOUBLE) * 0.618034{D}, 1.0{D}) * 120.0{D} - 60.0{D} AS dec"""
    extra = {
        "simbad": "p_type AS main_type",
        "gaia": f"p_name AS DR3Name, p_retailprice / 1000.0{D} AS Plx, CAST(p_size AS DOUBLE) / 100.0{D} AS e_Plx",
        "gcvs": "p_brand AS type",
    }[name]
    return f"cat AS (SELECT {pos}, {extra} FROM part)"


def haversine_arcsec(ra1, dec1, ra2, dec2) -> str:
    return (f"degrees(2.0{D} * asin(least(1.0{D}, sqrt(pow(sin(radians({dec2} - {dec1}) / 2), 2) "
            f"+ cos(radians({dec1})) * cos(radians({dec2})) * pow(sin(radians({ra2} - {ra1}) / 2), 2))))) * 3600.0{D}")


def best_match_cte(radius: float) -> str:
    r_deg = radius / 3600.0
    sep = haversine_arcsec("f.ra", "f.dec", "c.ra", "c.dec")
    return f"""pairs AS (
  SELECT f.candid, c.*, {sep} AS sep
  FROM flat f JOIN cat c ON c.dec BETWEEN f.dec - {r_deg * 1.01!r} AND f.dec + {r_deg * 1.01!r}
),
best AS (
  SELECT * FROM pairs WHERE sep <= {radius!r}
  QUALIFY row_number() OVER (PARTITION BY candid ORDER BY sep, source_id) = 1
)"""


def _sources(q):
    q["scan_alerts"] = w(ALERTS) + """
SELECT candid, objectId, jd, magpsf, CAST(len(prv) AS INTEGER) AS n_prv, year, month, day FROM alerts"""
    q["scan_night"] = w(FLAT) + """
SELECT candid, objectId, jd, year, month, day FROM flat WHERE year = 2024 AND month = 1 AND day = 7"""
    q["scan_class"] = w(FLAT) + """
SELECT candid, objectId, jd, event_type AS alertclass FROM flat WHERE event_type = 'purchase'"""
    q["scan_sso"] = w(FLAT) + """
SELECT objectId AS ssnamenr, CAST(count(*) AS INTEGER) AS n_obs,
  arg_min(jd, struct_pack(a := jd, b := candid)) AS jd_first,
  arg_max(jd, struct_pack(a := jd, b := candid)) AS jd_last
FROM flat WHERE magpsf IS NOT NULL GROUP BY objectId"""
    q["runs_roundtrip"] = f"""
SELECT event_type AS module, CAST(event_id % 2 AS INTEGER) AS loop,
  CASE WHEN user_id % 2 = 0 THEN 'spark' ELSE 'pandas' END AS engine,
  count(*) AS total_alerts, sum(value) / 1000.0{D} AS t_lapse, 8.0{D} AS n_cpu
FROM events GROUP BY ALL"""
    q["scan_catalog"] = w(catalog_cte("gaia")) + """
SELECT source_id, ra, dec, DR3Name, Plx, e_Plx FROM cat"""
    q["project_nested"] = w(FLAT) + """
SELECT objectId, candid, ra, dec, magpsf AS mag FROM flat"""
    q["project_literals"] = w(FLAT) + f"""
SELECT candid, 1.0{D} AS radius, 'simbad' AS simbad, 'main_type' AS main_type,
  CAST(1000 AS INTEGER) AS N, CAST(NULL AS BIGINT) AS seed FROM flat"""
    q["count_alerts"] = w(FLAT) + """
SELECT year, month, day, count(*) AS n_alerts FROM flat GROUP BY ALL"""


def _lightcurves(q):
    q["lightcurve_lengths"] = w(ALERTS) + """
SELECT candid, CAST(len(cjd) AS INTEGER) AS n_points,
  CAST(len(list_filter(cmagpsf, lambda x: x IS NOT NULL)) AS INTEGER) AS n_det, ndethist, jdstarthist
FROM lc"""
    names = ["cjd", "cmagpsf", "csigmapsf", "cfid", "cmagnr", "csigmagnr", "cisdiffpos", "cdiffmaglim", "cdistnr"]
    q["lightcurve_ztf"] = w(ALERTS) + f"""
SELECT candid, CAST(i AS INTEGER) AS pos, {", ".join(f"{n}[i + 1] AS {n}" for n in names)}
FROM (SELECT *, unnest(range(len(cjd))) AS i FROM lc)"""
    rn = ["cmidPointTai", "cpsFlux", "cpsFluxErr", "cfilterName"]
    q["lightcurve_rubin"] = w(RUBIN) + f"""
SELECT alertId, CAST(i AS INTEGER) AS pos, {", ".join(f"{n}[i + 1] AS {n}" for n in rn)}
FROM (SELECT *, unnest(range(len(cmidPointTai))) AS i FROM rlc)"""
    q["history_window"] = w(ALERTS) + """
SELECT candid, CAST(len(prv) AS INTEGER) AS n_prv, prv[1].jd AS prv_first_jd, prv[-1].jd AS prv_last_jd,
  ndethist, jdstarthist FROM alerts"""


def _xmatch(q):
    q["xmatch_simbad"] = w(FLAT, catalog_cte("simbad"), best_match_cte(1.0)) + """
SELECT f.candid, coalesce(b.main_type, 'Unknown') AS cdsxmatch, b.source_id
FROM flat f LEFT JOIN best b ON f.candid = b.candid"""
    q["xmatch_gaia"] = w(FLAT, catalog_cte("gaia"), best_match_cte(1.0)) + """
SELECT f.candid, b.DR3Name, b.Plx, b.e_Plx, b.source_id
FROM flat f LEFT JOIN best b ON f.candid = b.candid"""
    q["xmatch_local"] = w(FLAT, catalog_cte("gcvs"), best_match_cte(1.5)) + """
SELECT f.candid, coalesce(b.type, 'Unknown') AS gcvs, b.source_id
FROM flat f LEFT JOIN best b ON f.candid = b.candid"""


# ------------------------------------------------------------------ light-curve features (SQL mirror)


def _div(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) END)"


def _fold(arr: str, body: str, var: str = "x") -> str:
    return f"list_reduce({arr}, lambda acc, {var}: acc + ({body}), 0.0{D})"


def _q(a: str, p: float) -> str:
    pos = f"({p!r}{D} * CAST(n - 1 AS DOUBLE))"
    lo = f"CAST(floor({pos}) AS INTEGER)"
    frac = f"({pos} - CAST({lo} AS DOUBLE))"
    hi = f"least({lo} + 1, n - 1)"
    return f"({a}[{lo} + 1] + {frac} * ({a}[{hi} + 1] - {a}[{lo} + 1]))"


FEATURES = ALERTS + f""",
dce AS (
  SELECT candid, i, fr + sg * fd AS flux, sqrt((fr * sr) * (fr * sr) + (fd * s) * (fd * s)) AS ef FROM (
    SELECT candid, i, csigmapsf[i] AS s, csigmagnr[i] AS sr, pow(10.0{D}, -0.4{D} * cmagnr[i]) AS fr, pow(10.0{D}, -0.4{D} * cmagpsf[i]) AS fd,
      CASE WHEN cisdiffpos[i] IN ('t', '1') THEN 1.0{D} ELSE -1.0{D} END AS sg
    FROM (SELECT *, unnest(range(1, len(cjd) + 1)) AS i FROM lc))
),
dcl AS MATERIALIZED (
  SELECT candid, list(round(CASE WHEN flux > 0 THEN -2.5{D} * log10(flux) END, 6) ORDER BY i) AS dm,
    list(round(CASE WHEN flux > 0 THEN ef / flux END, 6) ORDER BY i) AS de
  FROM dce GROUP BY candid
),
lcd AS (SELECT lc.* REPLACE (dm AS cmagpsf, de AS csigmapsf) FROM lc JOIN dcl USING (candid)),
bp0 AS (
  SELECT candid, band,
    list_filter(list_transform(range(1, len(cjd) + 1), lambda i: struct_pack(t := cjd[i], m := cmagpsf[i],
        s := csigmapsf[i], f := cfid[i], d := cdistnr[i])), lambda x: x.f = band AND x.m IS NOT NULL) AS raw
  FROM lcd CROSS JOIN (VALUES (1), (2)) v(band)
),
bp AS MATERIALIZED (
  SELECT candid, band,
    list_transform(raw, lambda x: struct_pack(t := x.t - raw[1].t, m := x.m, s := x.s, d := x.d)) AS p
  FROM bp0
),
ba AS MATERIALIZED (
  SELECT *, CAST(len(p) AS INTEGER) AS n,
    {_div(_fold("list_transform(p, lambda y: y.m)", "x"), "CAST(len(p) AS DOUBLE)")} AS mean,
    list_sort(list_transform(p, lambda y: y.m)) AS sorted,
    {_fold("p", _div(f"1.0{D}", "x.s * x.s"))} AS w,
    {_fold("p", _div("x.m", "x.s * x.s"))} AS wm,
    {_div(_fold("p", "x.t"), "CAST(len(p) AS DOUBLE)")} AS tmean
  FROM bp
),
bb AS MATERIALIZED (
  SELECT *,
    {_div(_fold("p", "(x.m - mean) * (x.m - mean)"), "CAST(n - 1 AS DOUBLE)")} AS var,
    {_div("wm", "w")} AS wmean,
    {_q("sorted", 0.5)} AS median,
    {_fold("p", "(x.t - tmean) * (x.t - tmean)")} AS stt,
    {_fold("p", "(x.t - tmean) * (x.m - mean)")} AS stm,
    {_div(_fold("p", "x.d"), "CAST(n AS DOUBLE)")} AS mean_distnr
  FROM ba
),
bc AS MATERIALIZED (
  SELECT *, list_sort(list_transform(p, lambda x: abs(x.m - median))) AS absdev,
    sqrt(var) AS std,
    list_transform(range(2, n + 1), lambda i: struct_pack(dm := p[i].m - p[i - 1].m, dt := p[i].t - p[i - 1].t)) AS succ,
    {_div("stm", "stt")} AS slope
  FROM bb
),
bd AS MATERIALIZED (
  SELECT *, mean - slope * tmean AS intercept FROM bc
),
feat AS (
  SELECT candid, band, n,
    {{g}}mean{{e}} AS mean,
    {{g}}wmean{{e}} AS weighted_mean,
    {{g}}std{{e}} AS std,
    {{g}}(list_max(sorted) - list_min(sorted)) / 2{{e}} AS amplitude,
    {{g}}CASE WHEN n >= 2 AND var > 0 THEN {_div("CAST(len(list_filter(p, lambda x: abs(x.m - mean) > std)) AS DOUBLE)", "CAST(n AS DOUBLE)")} END{{e}} AS beyond_1_std,
    {{g}}{_div(_fold("p", _div("x.m - wmean", "x.s") + " * " + _div("x.m - wmean", "x.s")), "CAST(n - 1 AS DOUBLE)")}{{e}} AS chi2,
    {{g}}mean_distnr{{e}} AS mean_distnr,
    {{g}}slope{{e}} AS linear_trend,
    {{g}}CASE WHEN n >= 3 AND stt > 0 THEN sqrt({_div(_div(_fold("p", "(x.m - (intercept + slope * x.t)) * (x.m - (intercept + slope * x.t))"), "CAST(n - 2 AS DOUBLE)"), "stt")}) END{{e}} AS linear_trend_sigma,
    {{g}}list_max(list_transform(list_filter(succ, lambda d: d.dt > 0), lambda d: abs({_div("d.dm", "d.dt")}))){{e}} AS max_slope,
    {{g}}CASE WHEN n >= 2 AND var > 0 THEN {_div(_div(_fold("succ", "d.dm * d.dm", "d"), "CAST(n - 1 AS DOUBLE)"), "var")} END{{e}} AS eta,
    {{g}}median{{e}} AS median,
    {{g}}{_q("absdev", 0.5)}{{e}} AS mad,
    {{g}}greatest(abs(list_max(sorted) - median), abs(list_min(sorted) - median)){{e}} AS percent_amplitude,
    {{g}}{_q("sorted", 0.9)} - {_q("sorted", 0.1)}{{e}} AS q10_q90,
    {{g}}{_q("sorted", 0.75)} - {_q("sorted", 0.25)}{{e}} AS iqr,
    {{g}}CASE WHEN n >= 2 AND var > 0 AND n >= 3 THEN {_div("CAST(n AS DOUBLE)", "CAST((n - 1) * (n - 2) AS DOUBLE)")} * {_fold("p", "ZS * ZS * ZS")} END{{e}} AS skew,
    {{g}}CASE WHEN n >= 2 AND var > 0 AND n >= 4 THEN {_div("CAST(n AS DOUBLE) * CAST(n + 1 AS DOUBLE)", "CAST((n - 1) * (n - 2) * (n - 3) AS DOUBLE)")} * {_fold("p", "ZS * ZS * ZS * ZS")} - {_div(f"3.0{D} * CAST((n - 1) * (n - 1) AS DOUBLE)", "CAST((n - 2) * (n - 3) AS DOUBLE)")} END{{e}} AS kurtosis,
    {{g}}CASE WHEN SKDEN > 0 THEN {_div(_div(_fold("p", "abs(DK)"), "CAST(n AS DOUBLE)"), "SKDEN")} END{{e}} AS stetson_K
  FROM bd
)""".replace("{g}", "CASE WHEN n >= 2 THEN CAST(").replace("{e}", " AS DOUBLE) END").replace(
    "ZS", _div("x.m - mean", "std")).replace(
    "SKDEN", "sqrt(" + _div(_fold("p", "DK * DK"), "CAST(n AS DOUBLE)") + ")").replace(
    "DK", _div(f"sqrt({_div('CAST(n AS DOUBLE)', 'CAST(n - 1 AS DOUBLE)')}) * (x.m - wmean)", "x.s"))


def _features(q):
    groups = {
        "lc_features_basic": ["n", "mean", "weighted_mean", "std", "amplitude", "beyond_1_std", "chi2", "mean_distnr"],
        "lc_features_trend": ["linear_trend", "linear_trend_sigma", "max_slope", "eta"],
        "lc_features_quantile": ["median", "mad", "percent_amplitude", "q10_q90", "iqr"],
        "lc_features_pairs": ["skew", "kurtosis", "stetson_K"],
    }
    for key, cols in groups.items():
        q[key] = w(FEATURES) + f"""
SELECT candid, band, {", ".join(cols)} FROM feat"""


# ------------------------------------------------------------------ rates, D-mag, reports

RUNS = f"""runs AS (
  SELECT event_type AS module, CAST(event_id % 2 AS INTEGER) AS loop,
    CASE WHEN user_id % 2 = 0 THEN 'spark' ELSE 'pandas' END AS engine,
    count(*) AS total_alerts, sum(value) / 1000.0{D} AS t_lapse, 8.0{D} AS n_cpu
  FROM events GROUP BY ALL
),
tp AS (
  SELECT *, CASE WHEN engine = 'spark' THEN total_alerts / t_lapse / n_cpu ELSE total_alerts / t_lapse END AS throughput
  FROM runs
),
summ AS (
  SELECT module, engine, round(avg(throughput), 6) AS mean_tp, round(stddev_pop(throughput), 6) AS std_tp,
    count(*) AS n_loops
  FROM tp GROUP BY ALL
)"""


def _rates_reports(q):
    q["mag_rate"] = w(ALERTS) + f""",
pts AS (
  SELECT candid, magpsf, sigmapsf, jd,
    list_filter(list_transform(range(1, len(cjd)), lambda i: struct_pack(t := cjd[i], m := cmagpsf[i],
      s := csigmapsf[i], f := cfid[i], u := cdiffmaglim[i])),
      lambda p: p.f = fid AND p.t < jd AND p.t >= coalesce(jdstarthist, p.t)) AS earlier
  FROM lc
),
ref AS (
  SELECT *, list_filter(earlier, lambda p: p.m IS NOT NULL)[-1] AS det,
    list_filter(earlier, lambda p: p.u IS NOT NULL)[-1] AS ul FROM pts
),
ref2 AS (
  SELECT candid, magpsf, sigmapsf,
    CASE WHEN det IS NOT NULL THEN det.m WHEN ul IS NOT NULL THEN ul.u END AS pm,
    CASE WHEN det IS NOT NULL THEN det.s WHEN ul IS NOT NULL THEN 0.0{D} END AS ps,
    jd - CASE WHEN det IS NOT NULL THEN det.t WHEN ul IS NOT NULL THEN ul.t END AS dt,
    (det IS NULL AND ul IS NOT NULL) AS from_upper
  FROM ref
),
r3 AS (
  SELECT *, CASE WHEN dt > 0 THEN (magpsf - pm) / dt END AS rate,
    CASE WHEN dt > 0 THEN sqrt(sigmapsf * sigmapsf + ps * ps) / dt END AS sigma FROM ref2
)
SELECT candid, rate, sigma, rate - 1.6448536{D} * sigma AS lower, rate + 1.6448536{D} * sigma AS upper, dt, from_upper
FROM r3"""

    q["dc_mag"] = w(ALERTS) + f""",
e AS (
  SELECT candid, CAST(i AS INTEGER) AS pos, cmagpsf[i + 1] AS m, csigmapsf[i + 1] AS s, cmagnr[i + 1] AS mr,
    csigmagnr[i + 1] AS sr, cisdiffpos[i + 1] AS dp
  FROM (SELECT *, unnest(range(len(cjd))) AS i FROM lc)
),
f AS (
  SELECT *, pow(10.0{D}, -0.4{D} * mr) AS fr, pow(10.0{D}, -0.4{D} * m) AS fd,
    CASE WHEN dp IN ('t', '1') THEN 1.0{D} ELSE -1.0{D} END AS sg FROM e
)
SELECT candid, pos,
  round(CASE WHEN fr + sg * fd > 0 THEN -2.5{D} * log10(fr + sg * fd) END, 6) AS dcmag,
  round(CASE WHEN fr + sg * fd > 0 THEN sqrt((fr * sr) * (fr * sr) + (fd * s) * (fd * s)) / (fr + sg * fd) END, 6) AS dcmag_err
FROM f"""

    q["throughput_runs"] = w(RUNS) + """
SELECT module, loop, engine, round(throughput, 6) AS throughput FROM tp"""
    q["throughput_summary"] = w(RUNS) + """
SELECT * FROM summ"""
    q["throughput_targets"] = w(RUNS) + f"""
SELECT module, engine, mean_tp,
  mean_tp >= 75.0{D} AS meets_ztf_1s, mean_tp >= 37.5{D} AS meets_ztf_2s,
  mean_tp >= 62.5{D} AS meets_lsst_1s, mean_tp >= 31.25{D} AS meets_lsst_2s,
  CASE WHEN mean_tp >= 75.0{D} THEN 'ztf_1s' WHEN mean_tp >= 62.5{D} THEN 'lsst_1s'
       WHEN mean_tp >= 37.5{D} THEN 'ztf_2s' WHEN mean_tp >= 31.25{D} THEN 'lsst_2s' END AS best_target
FROM summ"""
    mods = ["click", "error", "purchase", "signup", "view"]
    piv = ", ".join(f"round(avg(throughput) FILTER (WHERE module = '{m}'), 6) AS {m}" for m in mods)
    q["runs_wide"] = w(RUNS) + f"""
SELECT loop, {piv},
  format('total_memory={{}}, gb_per_executor={{}}, core_per_executor={{}}, night={{}}, total_alerts={{}}',
         16, 2, 1, '20240716', sum(total_alerts)) AS config
FROM tp WHERE engine = 'spark' GROUP BY loop"""
    q["runs_long"] = w(RUNS) + """
SELECT loop, module, round(throughput, 6) AS throughput FROM tp WHERE engine = 'spark'"""
    q["emission_report"] = f"""
WITH er AS (
  SELECT event_type AS module, CAST(event_id % 2 AS INTEGER) AS loop,
    avg(value) * 1e-9{D} AS raw_rate, min(value) * 1e-9{D} AS baseline_rate
  FROM events GROUP BY ALL
),
e AS (
  SELECT module, raw_rate * 10512000.0{D} AS raw, baseline_rate * 10512000.0{D} AS base,
    (raw_rate - baseline_rate) * 10512000.0{D} AS diff FROM er
)
SELECT module, round(avg(raw), 6) AS raw_mean, round(stddev_pop(raw), 6) AS raw_std,
  round(avg(base), 6) AS base_mean, round(stddev_pop(base), 6) AS base_std,
  round(avg(diff), 6) AS diff_mean, round(stddev_pop(diff), 6) AS diff_std
FROM e GROUP BY module"""
    q["line_cost"] = """
WITH lp AS (
  SELECT event_type AS func, CAST(event_id % 17 + 31 AS INTEGER) AS line, count(*) AS hits, sum(value) AS time
  FROM events GROUP BY ALL
)
SELECT func, line, hits, round(time / hits, 6) AS per_hit,
  round(100.0 * time / sum(time) OVER (PARTITION BY func), 6) AS pct_time,
  round(hits / max(hits) OVER (PARTITION BY func), 6) AS hit_share,
  row_number() OVER (PARTITION BY func ORDER BY time DESC, line) = 1 AS is_top
FROM lp"""
    q["effective_share"] = w(ALERTS) + """,
s AS (
  SELECT event_type AS alertclass,
    CASE
      WHEN ssdistnr >= 0.0 AND ssdistnr < 5.0 THEN 3
      WHEN ndethist = 2 AND NOT (sgscore1 > 0.76 AND distpsnr1 < 1.0)
           AND (CASE WHEN len(dj) >= 2 THEN dj[-1] - dj[-2] END) <= 1.0 THEN 2
      WHEN ndethist = 1 AND NOT (sgscore1 > 0.76 AND distpsnr1 < 1.0) THEN 1
      ELSE 0 END AS roid
  FROM (SELECT *, list_filter(cjd, lambda x, i: cmagpsf[i] IS NOT NULL) AS dj FROM lc)
)
SELECT alertclass, count(*) AS n_alerts, CAST(sum(CASE WHEN roid > 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_positive,
  round(avg(CASE WHEN roid > 0 THEN 1.0 ELSE 0.0 END), 6) AS share
FROM s GROUP BY alertclass"""
    q["engine_ratio"] = w(RUNS) + """
SELECT a.module, a.mean_tp AS pandas_mean, b.mean_tp AS spark_mean, round(a.mean_tp / b.mean_tp, 6) AS ratio
FROM summ a JOIN summ b ON a.module = b.module AND a.engine = 'pandas' AND b.engine = 'spark'"""


# ------------------------------------------------------------------ stamps

STAMPS = """st AS (
  SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS sci, CAST(b.embedding AS DOUBLE[]) AS tpl
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1
)"""


def _clip_cols(a: str, k: str) -> str:
    n = f"CAST(len({a}) AS DOUBLE)"
    mean = f"(CASE WHEN {n} > 0 THEN {_fold(a, 'x')} / {n} END)"
    sd = f"(CASE WHEN {n} > 0 THEN sqrt({_fold(a, f'(x - {mean}) * (x - {mean})')} / {n}) END)"
    srt = f"list_sort({a})"
    nn = f"len({a})"
    pos = f"(0.5{D} * CAST({nn} - 1 AS DOUBLE))"
    lo = f"CAST(floor({pos}) AS INTEGER)"
    hi = f"least({lo} + 1, {nn} - 1)"
    med = f"({srt}[{lo} + 1] + ({pos} - CAST({lo} AS DOUBLE)) * ({srt}[{hi} + 1] - {srt}[{lo} + 1]))"
    return f"list_filter({a}, lambda x: abs(x - {med}) <= 3.0{D} * {sd}) AS {k}_c"


def _stamps(q):
    q["stamp_shape"] = w(STAMPS) + """
SELECT vec_id, CAST(len(sci) AS INTEGER) AS n_sci, CAST(len(tpl) AS INTEGER) AS n_tpl,
  coalesce(len(sci) = 64 AND len(tpl) = 64, false) AS shape_ok FROM st"""
    q["hostless"] = _hostless()
    stats = []
    for k in ("sci", "tpl"):
        c = f"{k}_c"
        n = f"CAST(len({c}) AS DOUBLE)"
        mean = f"(CASE WHEN {n} > 0 THEN {_fold(c, 'x')} / {n} END)"
        stats += [f"CAST(len({c}) AS INTEGER) AS n_kept_{k}", f"{mean} AS mean_{k}",
                  f"(CASE WHEN {n} > 0 THEN sqrt({_fold(c, f'(x - {mean}) * (x - {mean})')} / {n}) END) AS std_{k}"]
    q["stamp_sigma_clip"] = w(STAMPS) + f""",
cl AS MATERIALIZED (SELECT vec_id, {_clip_cols("sci", "sci")}, {_clip_cols("tpl", "tpl")} FROM st)
SELECT vec_id, {", ".join(stats)} FROM cl"""
    q["stamp_ks"] = w(STAMPS) + """,
px AS (
  SELECT vec_id, unnest(sci) AS v, 1 AS fa, len(sci) AS na, len(tpl) AS nb FROM st WHERE tpl IS NOT NULL
  UNION ALL
  SELECT vec_id, unnest(tpl) AS v, 0 AS fa, len(sci) AS na, len(tpl) AS nb FROM st WHERE tpl IS NOT NULL
),
cdf AS (
  SELECT vec_id,
    CAST(sum(fa) OVER cw AS DOUBLE) / na - CAST(sum(1 - fa) OVER cw AS DOUBLE) / nb AS d
  FROM px
  WINDOW cw AS (PARTITION BY vec_id ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
ks AS (SELECT vec_id, max(abs(d)) AS ks FROM cdf GROUP BY vec_id)
SELECT st.vec_id, ks.ks FROM st LEFT JOIN ks ON st.vec_id = ks.vec_id"""


def _hostless() -> str:
    """Five clip rounds, the test, the Fourier sums of both 8 x 8 stamps of a candidate, radial means, KS distance: pixels as rows."""
    sql = w(STAMPS) + """,
px AS MATERIALIZED (
  SELECT vec_id, 0 AS which, unnest(sci) AS v, unnest(range(64)) AS i FROM st WHERE len(sci) = 64 AND len(tpl) = 64
  UNION ALL SELECT vec_id, 1, unnest(tpl), unnest(range(64)) FROM st WHERE len(sci) = 64 AND len(tpl) = 64
),
clip0 AS (SELECT vec_id, which, v FROM px)"""
    for k in range(1, 6):
        sql += f""",
clip{k} AS MATERIALIZED (
  SELECT vec_id, which, v FROM (SELECT *, median(v) OVER g AS med, stddev_pop(v) OVER g AS sd FROM clip{k - 1} WINDOW g AS (PARTITION BY vec_id, which))
  WHERE abs(v - med) <= 3.0{D} * sd
)"""
    return sql + f""",
thr AS (SELECT vec_id, which, median(v) + 1.5{D} * stddev_pop(v) AS t FROM clip5 GROUP BY ALL),
above AS (SELECT vec_id, which, count(CASE WHEN v > t THEN 1 END) AS n FROM px JOIN thr USING (vec_id, which) GROUP BY ALL),
cand AS (SELECT vec_id FROM above GROUP BY vec_id HAVING max(CASE WHEN which = 1 THEN n END) < 3 AND max(CASE WHEN which = 0 THEN n END) >= 3),
freq AS (SELECT a.range AS p, b.range AS q, CAST(floor(sqrt(power((a.range + 4) % 8 - 4, 2) + power((b.range + 4) % 8 - 4, 2))) AS INTEGER) AS r FROM range(8) a, range(8) b),
power_ AS (
  SELECT vec_id, which, p, q, r, power(sum(v * cos(2 * pi() * (p * (i // 8) + q * (i % 8)) / 8)), 2) + power(sum(v * sin(2 * pi() * (p * (i // 8) + q * (i % 8)) / 8)), 2) AS z
  FROM px JOIN cand USING (vec_id) CROSS JOIN freq GROUP BY ALL
),
spec AS MATERIALIZED (SELECT vec_id, which, r, avg(z) AS z FROM power_ GROUP BY ALL),
cdf AS (
  SELECT vec_id, sum(CASE WHEN which = 0 THEN 1.0{D} / n ELSE 0 END) OVER g - sum(CASE WHEN which = 1 THEN 1.0{D} / n ELSE 0 END) OVER g AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY vec_id, which) AS n FROM spec)
  WINDOW g AS (PARTITION BY vec_id ORDER BY z RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
),
ks AS (SELECT vec_id, max(abs(d)) AS ks FROM cdf GROUP BY vec_id)
SELECT st.vec_id, coalesce(round(ks, 6), -99.0{D}) AS hostless FROM st LEFT JOIN ks ON ks.vec_id = st.vec_id"""


# ------------------------------------------------------------------ supervised modules: cuts and features

CURVE = ["n", "peak", "last", "mean", "slope", "rise_frac", "span", "err_mean"]


def _curve_sql(src: str, key: str, t: str, y: str, e: str, b: str, bands: list, brighter: str,
               since: str | None = None, extra: tuple = ()) -> str:
    """CTE text computing the curve summary per (key, band) from list columns of ``src``."""
    vals = ", ".join(f"({v!r})" for v in bands)
    cond = "x.b = band AND x.y IS NOT NULL" + (f" AND x.t >= {since}" if since else "")
    peak = "list_min(ys)" if brighter == "lower" else "list_max(ys)"
    up = "d < 0" if brighter == "lower" else "d > 0"
    ex = "".join(f", {c}" for c in extra)
    return f"""cp0 AS (
  SELECT {key}{ex}, band,
    list_filter(list_transform(range(1, len({t}) + 1), lambda i: struct_pack(t := {t}[i], y := {y}[i], e := {e}[i],
      b := {b}[i])), lambda x: {cond}) AS raw
  FROM {src} CROSS JOIN (VALUES {vals}) v(band)
),
cp AS MATERIALIZED (
  SELECT {key}{ex}, band, list_transform(raw, lambda x: struct_pack(t := x.t - raw[1].t, y := x.y, e := x.e)) AS q
  FROM cp0
),
cq AS MATERIALIZED (
  SELECT *, CAST(len(q) AS INTEGER) AS n, list_transform(q, lambda x: x.y) AS ys FROM cp
),
cr AS MATERIALIZED (
  SELECT *, {_div(_fold("ys", "x"), "CAST(n AS DOUBLE)")} AS my, {_div(_fold("q", "x.t"), "CAST(n AS DOUBLE)")} AS mt
  FROM cq
),
curve AS (
  SELECT {key}{ex}, band, n,
    CAST({peak} AS DOUBLE) AS peak, CAST(ys[-1] AS DOUBLE) AS last, my AS mean,
    CASE WHEN n >= 2 THEN {_div(_fold("q", "(x.t - mt) * (x.y - my)"), _fold("q", "(x.t - mt) * (x.t - mt)"))} END AS slope,
    CASE WHEN n >= 2 THEN {_div("CAST(len(list_filter(list_transform(range(2, n + 1), lambda i: q[i].y - q[i - 1].y), lambda d: " + up + ")) AS DOUBLE)", "CAST(n - 1 AS DOUBLE)")} END AS rise_frac,
    q[-1].t AS span,
    {_div(_fold("q", "x.e"), "CAST(n AS DOUBLE)")} AS err_mean
  FROM cr
)"""


KN_CUTS = """(coalesce(ndethist < 20 AND (jd - jdstarthist) < 20
   AND cdsxmatch IN ('Unknown', 'Candidate_SN*', 'SN', 'Transient', 'Fail')
   AND len(list_filter(cmagpsf, lambda x: x IS NOT NULL)) >= 2, false))"""


def _supervised(q):
    xm = w(ALERTS, catalog_cte("simbad"), best_match_cte(1.0)) + """,
xlc AS (
  SELECT lc.*, coalesce(b.main_type, 'Unknown') AS cdsxmatch FROM lc LEFT JOIN best b ON lc.candid = b.candid
)"""
    q["kn_cuts"] = xm + f"""
SELECT candid, cdsxmatch, {KN_CUTS} AS pass_cuts FROM xlc"""
    snia = _curve_sql("xlc", "candid", "cjd", "cmagpsf", "csigmapsf", "cfid", [1, 2], "lower",
                      extra=("ndethist", "cdsxmatch"))
    q["snia_cuts"] = xm + ",\n" + snia + """,
per AS (
  SELECT candid, ndethist, cdsxmatch,
    bool_and(n >= 3) AS enough, bool_or(n >= 3 AND slope < 0) AS rising
  FROM curve GROUP BY ALL
)
SELECT candid, coalesce(ndethist <= 20 AND enough AND rising
  AND cdsxmatch IN ('Unknown', 'Candidate_SN*', 'SN', 'Transient', 'Fail'), false) AS pass_cuts FROM per"""
    slot = "CASE WHEN t1 > t0 THEN least(CAST(floor((x.t - t0) / (t1 - t0) * 16) AS INTEGER), 15) ELSE 0 END"
    q["snn_vector"] = w(ALERTS) + f""",
p AS (
  SELECT candid, list_filter(list_transform(range(1, len(cjd) + 1),
      lambda i: struct_pack(t := cjd[i], y := cmagpsf[i], b := cfid[i])), lambda x: x.y IS NOT NULL) AS z FROM lc
),
r AS (SELECT candid, z, list_min(list_transform(z, lambda x: x.t)) AS t0, list_max(list_transform(z, lambda x: x.t)) AS t1 FROM p),
v AS (
  SELECT candid, band, slot, list_filter(z, lambda x: x.b = band AND {slot} = slot) AS q
  FROM r CROSS JOIN (VALUES (1), (2)) t(band) CROSS JOIN (SELECT CAST(range AS INTEGER) AS slot FROM range(16))
)
SELECT candid, band, slot, {_div(_fold("q", "x.y"), "CAST(len(q) AS DOUBLE)")} AS mag FROM v"""
    slsn_md = ("hostgal_zphot", "hostgal_zphot_err", "hostgal_snsep")
    q["slsn_features_md"] = w(RUBIN, _curve_sql("rlc", "alertId", "cmidPointTai", "cpsFlux", "cpsFluxErr",
                                                "cfilterName", ["u", "g", "r", "i", "z", "Y"], "higher", extra=slsn_md)) + f"""
SELECT alertId, {", ".join(slsn_md)}, band, {", ".join(CURVE)} FROM curve"""
    cats_md = ("mwebv", "z_final", "z_final_err", "hostgal_zphot", "hostgal_zphot_err")
    rl = RUBIN + """,
rlc2 AS (SELECT *, hostgal_zphot AS z_final, hostgal_zphot_err AS z_final_err FROM rlc)"""
    q["cats_features_md"] = w(rl, _curve_sql("rlc2", "alertId", "cmidPointTai", "cpsFlux", "cpsFluxErr",
                                             "cfilterName", ["u", "g", "r", "i", "z", "Y"], "higher", extra=cats_md)) + f"""
SELECT alertId, {", ".join(cats_md)}, band, {", ".join(CURVE)} FROM curve"""


# ------------------------------------------------------------------ solar-system and user functions


def _sso_user(q):
    tol = 1.0 / 1440.0
    q["sso_phase_linear"] = w(FLAT) + f""",
obs AS (SELECT objectId AS ssnamenr, candid, jd, fid, magpsf FROM flat WHERE magpsf IS NOT NULL),
eph AS (
  SELECT objectId AS ssnamenr,
    jd + CAST((candid % 7) - 3 AS DOUBLE) * 10.0{D} / 86400.0{D} AS ejd,
    CAST(candid % 25 + 1 AS DOUBLE) AS phase_deg,
    2.0{D} + CAST(user_id % 10 AS DOUBLE) / 10.0{D} AS r_au
  FROM flat WHERE magpsf IS NOT NULL
),
m AS (
  SELECT o.*, e.phase_deg, e.r_au, e.r_au - 1.0{D} AS delta_au
  FROM obs o LEFT JOIN eph e ON o.ssnamenr = e.ssnamenr AND abs(o.jd - e.ejd) <= {tol!r}
  QUALIFY row_number() OVER (PARTITION BY o.candid ORDER BY abs(o.jd - e.ejd), e.ejd) = 1
),
r AS (SELECT *, magpsf - 5.0{D} * log10(r_au * delta_au) AS mred FROM m)
SELECT ssnamenr, fid, count(mred) AS n_obs, round(regr_intercept(mred, phase_deg), 5) AS H,
  round(regr_slope(mred, phase_deg), 5) AS beta
FROM r GROUP BY ALL"""
    q["udf_scalar"] = w(ALERTS) + f"""
SELECT candid, CAST(len(d) AS INTEGER) AS n_det,
  CASE WHEN len(d) > 0 THEN {_fold("d", "x")} / len(d) END AS mean_mag
FROM (SELECT candid, list_filter(cmagpsf, lambda x: x IS NOT NULL) AS d FROM lc)"""
    q["udf_vectorised"] = w(FLAT) + f"""
SELECT candid, 1.0857{D} / sigmapsf AS snr FROM flat"""
    q["udf_grouped"] = w(FLAT) + """
SELECT objectId, count(magpsf) AS n_det, round(coalesce(sum(magpsf), 0.0::DOUBLE), 4) AS mag_sum
FROM flat GROUP BY objectId"""


# ------------------------------------------------------------------ properties of fitted or drawn results


def _checks(q):
    q["mag_rate_mc_check"] = f"""
SELECT candid, rate IS NOT NULL AND sigma IS NOT NULL AS has_bounds,
  CASE WHEN rate IS NOT NULL AND sigma IS NOT NULL THEN true END AS near_closed_form
FROM ({q["mag_rate"]})"""
    q["repartition_check"] = w(FLAT) + """
SELECT count(*) AS n_alerts, true AS balanced FROM flat"""
    for k in ("kn", "snia"):
        q[f"{k}_score_check"] = f"SELECT candid, pass_cuts, true AS score_ok FROM ({q[f'{k}_cuts']})"
    q["mulens_score_check"] = w(FEATURES.split("dcl AS MATERIALIZED")[0].rstrip().rstrip(",")) + """
SELECT candid, coalesce(count(CASE WHEN flux > 0 AND cfid[i] = 1 THEN 1 END) >= 4 AND count(CASE WHEN flux > 0 AND cfid[i] = 2 THEN 1 END) >= 4, false) AS pass_cuts,
  true AS score_ok
FROM lc JOIN dce USING (candid) GROUP BY candid"""
    q["snn_score_check"] = f"""
SELECT k.candid, n >= 2 AND a.roid < 3 AND cdsxmatch IN ('Unknown', 'Candidate_SN*', 'SN', 'Transient', 'Fail') AS pass_cuts, true AS score_ok
FROM ({q["kn_cuts"]}) k JOIN ({q["asteroid_flag"]}) a USING (candid)
JOIN ({w(ALERTS)} SELECT candid, len(list_filter(cmagpsf, lambda x: x IS NOT NULL)) AS n FROM lc) d USING (candid)"""
    q["snia_rise_check"] = f"SELECT candid, CAST(band AS INTEGER) AS band, rise_status AS status, true AS fit_ok FROM ({q['snia_features']})"
    q["module_chain_check"] = f"""
SELECT candid, cdsxmatch, CAST(roid AS INTEGER) AS roid, true AS scores_ok
FROM ({q["kn_cuts"]}) k JOIN ({q["asteroid_flag"]}) a USING (candid)"""
    for k in ("slsn", "cats"):
        q[f"{k}_score_check"] = f"SELECT DISTINCT alertId, true AS score_ok FROM ({q[f'{k}_features_md']})"
