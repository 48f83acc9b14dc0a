"""DuckDB statements of the solar-system fits: phase curves per band, chi2 over the grid, and the whole joint search."""

from __future__ import annotations

import math

import numpy as np

D = "::DOUBLE"

# Knots (degrees), values and end slopes (per radian) of the H,G1,G2 phase functions
# of Muinonen et al. 2010; phi1 and phi2 are straight lines below 7.5 degrees.
PHI1 = ([7.5, 30, 60, 90, 120, 150], [0.75, 0.33486016, 0.134105601, 0.0511047561, 0.0214656870, 0.0036396989], (-1.9098593, -0.0913286))
PHI2 = ([7.5, 30, 60, 90, 120, 150], [0.925, 0.62884169, 0.31755495, 0.12716367, 0.0223739005, 0.000165056890], (-0.57295780, -8.6573138e-8))
PHI3 = ([0, 0.3, 1, 2, 4, 8, 12, 20, 30], [1, 0.83381185, 0.57735424, 0.42144772, 0.23174230, 0.10348178, 0.0617334729, 0.0161070063, 0], (-106.30097 * 1e-3 * 180 / math.pi, 0.0))


def _lit(x: float) -> str:
    return f"({float(x)!r}{D})"


def hermite(knots, values, ends, a: str = "a") -> str:
    """The clamped cubic spline in Hermite form: the slopes at the knots solve a tridiagonal system."""
    x, y = np.radians(np.array(knots, float)), np.array(values, float)
    h, n = np.diff(x), len(x)
    m, r = np.eye(n), np.zeros(n)
    r[0], r[-1] = ends
    for i in range(1, n - 1):
        m[i, i - 1], m[i, i], m[i, i + 1] = 1 / h[i - 1], 2 / h[i - 1] + 2 / h[i], 1 / h[i]
        r[i] = 3 * ((y[i] - y[i - 1]) / h[i - 1] ** 2 + (y[i + 1] - y[i]) / h[i] ** 2)
    k = np.linalg.solve(m, r)
    cases = []
    for i in range(n - 1):
        t = f"(({a} - {_lit(x[i])}) / {_lit(h[i])})"
        value = (f"((1 + 2 * {t}) * (1 - {t}) * (1 - {t}) * {_lit(y[i])} + {t} * (1 - {t}) * (1 - {t}) * {_lit(h[i] * k[i])}"
                 f" + {t} * {t} * (3 - 2 * {t}) * {_lit(y[i + 1])} + {t} * {t} * ({t} - 1) * {_lit(h[i] * k[i + 1])})")
        cases.append(f"WHEN {a} < {_lit(x[i + 1])} THEN {value}" if i < n - 2 else f"ELSE {value}")
    return "CASE " + " ".join(cases) + " END"


def observed(flat: str) -> str:
    """CTEs up to ``seen``: reduced magnitude, phase functions and position of each observation."""
    low = _lit(math.radians(7.5))
    return f"""{flat},
obs AS (
  SELECT objectId AS ssnamenr, candid, jd, fid, magpsf, sigmapsf, dec,
    fmod(ra + CAST(candid % 12 AS DOUBLE) * 30.0{D}, 360.0{D}) AS ra
  FROM flat WHERE magpsf IS NOT NULL
),
eph AS (
  SELECT objectId AS ssnamenr, jd + CAST((candid % 7) - 3 AS DOUBLE) * 10.0{D} / 86400.0{D} AS ejd,
    CAST(candid % 25 + 1 AS DOUBLE) AS phase_deg, 2.0{D} + CAST(user_id % 10 AS DOUBLE) / 10.0{D} AS r_au
  FROM flat WHERE magpsf IS NOT NULL
),
near AS (
  SELECT o.*, e.phase_deg, e.r_au FROM obs o LEFT JOIN eph e ON o.ssnamenr = e.ssnamenr AND abs(o.jd - e.ejd) <= {1 / 1440!r}
  QUALIFY row_number() OVER (PARTITION BY o.candid ORDER BY abs(o.jd - e.ejd), e.ejd, e.phase_deg, e.r_au) = 1
),
seen AS MATERIALIZED (
  SELECT *, CASE WHEN a < {low} THEN 1 - a * 6 / pi() ELSE {hermite(*PHI1)} END AS p0,
    CASE WHEN a < {low} THEN 1 - a * 9 / (5 * pi()) ELSE {hermite(*PHI2)} END AS p1,
    CASE WHEN a > {_lit(math.radians(30))} THEN 0.0{D} ELSE {hermite(*PHI3)} END AS p2,
    power(10.0{D}, -0.4{D} * (magpsf - 5.0{D} * log10(r_au * (r_au - 1.0{D})))) AS y,
    1.0{D} / (0.4{D} * ln(10.0{D}) * sigmapsf) AS v
  FROM (SELECT *, radians(phase_deg) AS a FROM near)
)"""


def _sets() -> list[tuple[int, ...]]:
    return [(0, 1, 2), (0, 1), (0, 2), (1, 2), (0,), (1,), (2,)]


def _solution(free: tuple[int, ...]) -> tuple[list[str], str]:
    """Coefficients of the normal equations with only some free, and whether they are regular (Cramer's rule)."""
    a = lambda i, j: f"a{min(i, j)}{max(i, j)}"

    def det(m):
        if len(m) == 1:
            return m[0][0]
        if len(m) == 2:
            return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
        minor = lambda k: [[r[j] for j in range(3) if j != k] for r in m[1:]]
        return f"({m[0][0]} * {det(minor(0))} - {m[0][1]} * {det(minor(1))} + {m[0][2]} * {det(minor(2))})"

    base = [[a(i, j) for j in free] for i in free]
    whole = det(base)
    c = ["0.0" + D] * 3
    for at, k in enumerate(free):
        c[k] = f"({det([[f'b{i}' if j == at else base[r][j] for j in range(len(free))] for r, i in enumerate(free)])} / {whole})"
    floor = "0" if len(free) == 1 else "1e-9 * " + " * ".join(a(i, i) for i in free)
    return c, f"{whole} > {floor}"


def solved(source: str) -> str:
    """``source`` with the best nonnegative coefficients c0..c2 and chi2."""
    trials, names = [], []
    for k, free in enumerate(_sets()):
        c, regular = _solution(free)
        trials.append(f"CASE WHEN {regular} THEN struct_pack(gain := {c[0]} * b0 + {c[1]} * b1 + {c[2]} * b2, c0 := {c[0]}, c1 := {c[1]}, c2 := {c[2]}) END AS t{k}")
        names.append(f"CASE WHEN t{k}.c0 >= 0 AND t{k}.c1 >= 0 AND t{k}.c2 >= 0 THEN t{k}.gain END")
    best = f"greatest({', '.join(f'coalesce({n}, 0.0{D})' for n in names)})"
    pick = lambda c: "CASE " + " ".join(f"WHEN {n} = gain THEN t{k}.{c}" for k, n in enumerate(names)) + f" ELSE 0.0{D} END AS {c}"
    return f"SELECT *, vv - gain AS chi2, {pick('c0')}, {pick('c1')}, {pick('c2')} FROM (SELECT *, {best} AS gain FROM (SELECT *, {', '.join(trials)} FROM {source}))"


def _sums(points: str) -> str:
    """Normal equations per object, band and point; ``points``: CTE with g, ra0, dec0, R and, when they differ, ssnamenr."""
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    on = "ON p.ssnamenr = o.ssnamenr" if points != "grid" else "ON true"
    return f"""SELECT ssnamenr, fid, g, ra0, dec0, R, count(*) AS n, sum(v * v) AS vv,
    {", ".join(f"sum(q{i} * q{j} / (s * s)) AS a{i}{j}" for i, j in pairs)}, {", ".join(f"sum(q{i} * v / s) AS b{i}" for i in range(3))}
  FROM (
    SELECT o.ssnamenr, fid, q0, q1, q2, v, p.g, p.ra0, p.dec0, p.R,
      1 - (1 - p.R) * abs(sin(radians(o.dec)) * sin(radians(p.dec0)) + cos(radians(o.dec)) * cos(radians(p.dec0)) * cos(radians(o.ra) - radians(p.ra0))) AS s
    FROM used o JOIN {points} p {on}
  ) GROUP BY ssnamenr, fid, g, ra0, dec0, R"""


def _stage(k: str, points: str) -> str:
    return f"""sum{k} AS MATERIALIZED ({_sums(points)}),
fit{k} AS MATERIALIZED ({solved(f"sum{k}")}),
chi{k} AS MATERIALIZED (
  SELECT ssnamenr, g, ra0, dec0, R, sum(chi2) AS chi2, sum(vv) AS vv, round(sum(chi2) / sum(vv), 11) AS rel
  FROM fit{k} GROUP BY ssnamenr, g, ra0, dec0, R
)"""


def _grid() -> str:
    """Fixed values of the coarse grid: rings 15 degrees apart, evenly dense, five flattenings and the sphere."""
    rows, sky, g = [], [], 0
    for dec in (7.5, 22.5, 37.5, 52.5, 67.5, 82.5):
        n = max(3, int(round(24 * math.cos(math.radians(dec)))))
        sky += [(360.0 * i / n, dec) for i in range(n)]
    for d, (ra, dec) in enumerate(sky):
        for r in (0.35, 0.5, 0.65, 0.8, 0.9):
            rows.append(f"({g}, {d}, {ra!r}{D}, {dec!r}{D}, {r!r}{D})")
            g += 1
    rows.append(f"({g}, NULL, 0.0{D}, 90.0{D}, 1.0{D})")
    return f"grid AS (SELECT * FROM (VALUES {', '.join(rows)}) t(g, d, ra0, dec0, R))"


def _used(flat: str) -> str:
    return observed(flat) + """,
used AS MATERIALIZED (
  SELECT ssnamenr, fid, v * p0 / y AS q0, v * p1 / y AS q1, v * p2 / y AS q2, v, ra, dec
  FROM seen WHERE p0 IS NOT NULL AND y IS NOT NULL AND phase_deg BETWEEN 0 AND 150
)"""


def _search(flat: str) -> str:
    """CTEs of the whole search, up to ``one`` (the chosen point), ``fitlast`` and ``chilast``."""
    steps = ((7.5, 0.075), (3.75, 0.0375), (1.875, 0.02), (0.9, 0.01), (0.45, 0.005), (0.2, 0.0025))
    offsets = ((0, 0), (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1))
    around = ", ".join(f"({9 * k + o}, {dr}, {i}, {j})" for k, dr in enumerate((0, -1, 1)) for o, (i, j) in enumerate(offsets))
    sql = f"""WITH {_used(flat)},
{_grid()},
{_stage("c", "grid")},
sky AS (
  SELECT ssnamenr, d, x.rel, x.g, x.ra0, x.dec0, x.R FROM (
    SELECT ssnamenr, d, min(struct_pack(rel := rel, g := g, ra0 := c.ra0, dec0 := c.dec0, R := c.R)) AS x FROM chic c JOIN grid USING (g) WHERE d IS NOT NULL GROUP BY ssnamenr, d)
),
close AS (
  SELECT DISTINCT x.d, y.d AS e FROM grid x JOIN grid y ON x.d <> y.d AND abs(sin(radians(x.dec0)) * sin(radians(y.dec0))
    + cos(radians(x.dec0)) * cos(radians(y.dec0)) * cos(radians(x.ra0 - y.ra0))) > cos(radians(22.0{D}))
),
minima AS (
  SELECT * FROM sky s WHERE NOT EXISTS (SELECT 1 FROM close JOIN sky t ON t.d = close.e WHERE close.d = s.d AND t.ssnamenr = s.ssnamenr AND t.rel < s.rel)
),
few AS (SELECT *, row_number() OVER (PARTITION BY ssnamenr ORDER BY rel, g) AS nth FROM minima QUALIFY nth <= 4),
best0 AS MATERIALIZED (
  SELECT ssnamenr, nth - 1 AS start, ra0, dec0, R FROM few
  UNION ALL SELECT ssnamenr, (SELECT count(*) FROM few x WHERE x.ssnamenr = c.ssnamenr), ra0, dec0, R FROM chic c WHERE g = (SELECT max(g) FROM grid)
),
off AS (SELECT * FROM (VALUES {around}) t(o, dr, i, j))"""
    for k, (step, ratio) in enumerate(steps, 1):
        sql += f""",
pt{k} AS MATERIALIZED (
  SELECT ssnamenr, start * 27 + o AS g, greatest(0.3{D}, least(1.0{D}, R + dr * {ratio!r}{D})) AS R,
    degrees(asin(greatest(-1.0{D}, least(1.0{D}, sd)))) AS dec0,
    (degrees(radians(ra0) + atan2(sin(way) * sin(far) * cos(radians(dec0)), cos(far) - sin(radians(dec0)) * sd)) + 720.0{D}) % 360.0{D} AS ra0
  FROM (
    SELECT *, sin(radians(dec0)) * cos(far) + cos(radians(dec0)) * sin(far) * cos(way) AS sd FROM (
      SELECT b.*, o, dr, radians({step!r}{D}) * sqrt(i * i + j * j) AS far, atan2(i, j) AS way FROM best{k - 1} b CROSS JOIN off))
),
{_stage(str(k), f"pt{k}")},
best{k} AS MATERIALIZED (
  SELECT ssnamenr, start, x.ra0, x.dec0, x.R, x.rel FROM (
    SELECT ssnamenr, g // 27 AS start, min(struct_pack(rel := rel, g := g, ra0 := ra0, dec0 := dec0, R := R)) AS x FROM chi{k} GROUP BY ssnamenr, g // 27)
)"""
    return sql + f""",
one AS MATERIALIZED (SELECT ssnamenr, 0 AS g, ra0, dec0, R FROM best{len(steps)} QUALIFY row_number() OVER (PARTITION BY ssnamenr ORDER BY rel, start) = 1),
{_stage("last", "one")},
size AS (SELECT ssnamenr, count(*) AS n_obs, count(DISTINCT fid) AS n_bands FROM used GROUP BY ssnamenr),
every AS (
  SELECT DISTINCT o.ssnamenr, coalesce(n_obs, 0) AS n_obs, n_obs > 3 + 3 * n_bands AS enough, l.ra0, l.dec0, l.R, l.chi2 / l.vv AS misfit,
    CASE WHEN n_obs IS NULL THEN 'no_ephemeris' WHEN n_obs <= 3 + 3 * n_bands THEN 'too_few_points' WHEN l.R <= 0.3{D} THEN 'at_bound' ELSE 'ok' END AS status
  FROM obs o LEFT JOIN size USING (ssnamenr) LEFT JOIN chilast l USING (ssnamenr)
)"""


def add(q: dict[str, str], flat: str) -> None:
    w = "power(v / y, 2)"
    pairs = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    c, _ = _solution((0, 1, 2))
    det = _solution((0, 1, 2))[1].split(" > ")[0]
    q["sso_hg1g2"] = f"""WITH {observed(flat)},
sums AS (
  SELECT ssnamenr, fid, count(CASE WHEN phase_deg BETWEEN 0 AND 150 THEN y END) AS n_obs, sum({w} * y * y) AS yy,
    {", ".join(f"sum({w} * p{i} * p{j}) AS a{i}{j}" for i, j in pairs)}, {", ".join(f"sum({w} * p{i} * y) AS b{i}" for i in range(3))}
  FROM seen GROUP BY ssnamenr, fid
),
sol AS (SELECT *, CASE WHEN abs({det}) > 1e-9 * a00 * a11 * a22 THEN struct_pack(c0 := {c[0]}, c1 := {c[1]}, c2 := {c[2]}) END AS c FROM sums),
fin AS (SELECT *, c.c0 + c.c1 + c.c2 AS total, coalesce(n_obs >= 6 AND c.c0 + c.c1 + c.c2 > 0, false) AS fine FROM sol)
SELECT ssnamenr, fid, n_obs, CASE WHEN fine THEN round(-2.5{D} * log10(total), 4) END AS H, CASE WHEN fine THEN round(c.c0 / total, 4) END AS G1,
  CASE WHEN fine THEN round(c.c1 / total, 4) END AS G2,
  CASE WHEN n_obs = 0 THEN 'no_ephemeris' WHEN n_obs < 6 THEN 'too_few_points' WHEN NOT fine THEN 'singular' ELSE 'ok' END AS status,
  CASE WHEN fine THEN round((yy - c.c0 * b0 - c.c1 * b1 - c.c2 * b2) / yy, 6) END AS misfit
FROM fin"""
    q["sso_grid"] = f"""WITH {_used(flat)},
{_grid()},
{_stage("c", "grid")}
SELECT ssnamenr, g, round(ra0, 6) AS ra0, dec0, R, round(chi2 / vv, 7) AS misfit FROM chic"""
    q["sso_spin"] = f"""{_search(flat)}
SELECT ssnamenr, n_obs, CASE WHEN enough THEN round(ra0, 3) END AS ra0, CASE WHEN enough THEN round(dec0, 3) END AS dec0,
  CASE WHEN enough THEN round(R, 4) END AS R, CASE WHEN enough THEN round(misfit, 6) END AS misfit, status FROM every"""
    q["ssoft_params"] = f"""{_search(flat)}
SELECT e.ssnamenr, f.fid, e.status, f.n AS n_obs, round(e.R, 4) AS R, round(-2.5{D} * log10(c0 + c1 + c2), 4) AS H,
  round(c0 / (c0 + c1 + c2), 4) AS G1, round(c1 / (c0 + c1 + c2), 4) AS G2
FROM every e JOIN fitlast f USING (ssnamenr) WHERE e.enough"""
