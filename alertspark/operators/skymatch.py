"""Cone cross-match of alerts against a reference catalogue.

A distance predicate alone makes Spark plan a nested-loop join, so positions
are turned into equi-join keys first (zones algorithm, Gray, Nieto-Santisteban
& Szalay 2006):

* zone ``z = floor((dec + 90) / h)`` with ``h >= 2 * radius``;
* inside zone ``z`` the RA circle is cut into ``nb(z)`` buckets wide enough
  that a cone reaches at most the two neighbouring buckets;
* an alert gets exactly one ``(zone, bucket)`` key; a catalogue row is copied
  to the neighbouring zone / bucket only when its cone crosses that border
  (so most rows get one key, not nine).

The join is then an equi-join on ``(zone, bucket)`` plus an exact haversine
filter ``sep <= radius``.

A cell that holds many sources (a cluster, the galactic plane) is dense: an
alert in it looks up a second, finer grid, whose cells are as small as the
radius allows, and which holds only the sources of dense cells.

Two physical plans:

* **broadcast** (catalogue checked to be at most ``broadcast_rows`` rows and
  BROADCAST_BYTES): catalogue rows are grouped per cell into arrays and
  broadcast; each alert picks its nearest candidate with array functions, so
  the alert table is never shuffled;
* **shuffle**: narrow alert keys join the exploded catalogue keys (inner
  equi-join, AQE can split skewed cells on either side), the nearest source is
  chosen by an aggregate per alert id, and the result is joined back on the
  unique alert id.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertspark.functions.arrays import let
from alertspark.session import cpu_count, reliable_checkpoint

DEFAULT_BROADCAST_ROWS = 2_000_000
#: Bytes of positions, ids and payload that may be broadcast.
BROADCAST_BYTES = 256 << 20
MIN_ZONE_ARCSEC = 10.0
#: Sources from which a cell is dense.
DENSE = 64
EPS_DEG = 1e-9


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zone_height_deg(radius_arcsec: float, min_zone_arcsec: float = MIN_ZONE_ARCSEC) -> float:
    return max(2.0 * radius_arcsec, min_zone_arcsec) / 3600.0


def haversine_deg(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle separation in degrees (haversine form: stable at small angles)."""
    sd = F.sin(F.radians(dec2 - dec1) / 2)
    sr = F.sin(F.radians(ra2 - ra1) / 2)
    a = sd * sd + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * sr * sr
    return F.degrees(F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


class _Grid:
    def __init__(self, radius_arcsec: float, min_zone_arcsec: float = MIN_ZONE_ARCSEC):
        self.r = radius_arcsec / 3600.0
        self.h = zone_height_deg(radius_arcsec, min_zone_arcsec)
        self.nz = int(math.ceil(180.0 / self.h))

    def zone(self, dec: Column) -> Column:
        return F.least(F.floor((dec + F.lit(90.0)) / F.lit(self.h)), F.lit(self.nz - 1)).cast("long")

    def low(self, z: Column) -> Column:
        return z.cast("double") * F.lit(self.h) - F.lit(90.0)

    def high(self, z: Column) -> Column:
        return (z + 1).cast("double") * F.lit(self.h) - F.lit(90.0)

    def nbuckets(self, z: Column) -> Column:
        m = F.least(F.greatest(F.abs(self.low(z)), F.abs(self.high(z))), F.lit(90.0))
        mm = m + F.lit(2.0 * self.r)
        return (
            F.when(mm >= F.lit(89.0), F.lit(1))
            .otherwise(F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(mm)) / F.lit(self.h))))
            .cast("long")
        )

    def bucket(self, ra: Column, nb: Column) -> Column:
        return F.pmod(F.floor(ra / (F.lit(360.0) / nb)).cast("long"), nb)

    def alert_key(self, ra: Column, dec: Column) -> tuple[Column, Column]:
        z = self.zone(dec)
        return z, self.bucket(ra, self.nbuckets(z))

    def catalog_keys(self, ra: Column, dec: Column) -> Column:
        """Array of (zone, bucket) structs a catalogue row must be copied to."""
        z = self.zone(dec)
        r = F.lit(self.r)
        eps = F.lit(EPS_DEG)
        ad = F.abs(dec) + r
        dra = F.when(ad >= F.lit(89.99), F.lit(360.0)).otherwise(
            F.lit(1.01) * r / F.cos(F.radians(ad)) + eps)
        parts = []
        for dz in (-1, 0, 1):
            zt = z + dz
            if dz == -1:
                cond = (dec - r <= self.low(z) + eps) & (zt >= 0)
            elif dz == 1:
                cond = (dec + r >= self.high(z) - eps) & (zt < self.nz)
            else:
                cond = F.lit(True)
            nb = self.nbuckets(zt)
            width = F.lit(360.0) / nb
            b = self.bucket(ra, nb)
            lo = b.cast("double") * width
            hi = lo + width
            near = F.filter(
                F.array(
                    b,
                    F.when(ra - dra <= lo + eps, F.pmod(b - 1, nb)),
                    F.when(ra + dra >= hi - eps, F.pmod(b + 1, nb)),
                ),
                lambda x: x.isNotNull(),
            )
            buckets = (
                F.when(nb == 1, F.array(F.lit(0).cast("long")))
                .when(dra >= width, F.sequence(F.lit(0).cast("long"), nb - 1))
                .otherwise(F.array_distinct(near))
            )
            cell = F.transform(buckets, _cell_of(zt))
            empty = F.array().cast("array<struct<zone:bigint,bucket:bigint>>")
            parts.append(F.when(cond, cell).otherwise(empty))
        return F.flatten(F.array(*parts))


def _cell_of(zt: Column):
    # one-argument lambda (a second argument would be read as the element index)
    return lambda bb: F.struct(zt.alias("zone"), bb.alias("bucket"))


def _catalog_cells(catalog: DataFrame, grid: _Grid, payload: Sequence[str], ra: str, dec: str,
                   source_id: str) -> DataFrame:
    cols = [F.col(ra).alias("_cra"), F.col(dec).alias("_cdec"), F.col(source_id).alias("source_id")]
    cols += [F.col(p) for p in payload]
    return catalog.select(
        F.explode(grid.catalog_keys(F.col(ra), F.col(dec))).alias("_cell"), *cols
    ).select(F.col("_cell.zone").alias("_zone"), F.col("_cell.bucket").alias("_bucket"), "*").drop("_cell")


def catalog_fits_broadcast(catalog: DataFrame, max_rows: int, max_bytes: int | None = None, payload: Sequence[str] = ()) -> bool:
    """Proven size bound: the catalogue has at most ``max_rows`` rows (a LIMIT, stops early), of at most ``max_bytes`` with their copies."""
    if max_rows <= 0:
        return False
    width = F.lit(32)
    for p in payload:
        width = width + F.coalesce(F.octet_length(F.col(p).cast("string")), F.lit(0)) + F.lit(8)
    got = catalog.limit(max_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    return got["n"] <= max_rows and 2 * (got["bytes"] or 0) <= (BROADCAST_BYTES if max_bytes is None else max_bytes)


def _split_dense(catalog: DataFrame, grid: _Grid, fine: _Grid | None, payload: Sequence[str], ra: str, dec: str, source_id: str, dense: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(cells of the grid without dense ones, cells of the finer grid with the dense ones' sources, keys of the dense cells)."""
    # the keys take long expressions and are read up to four times: they are made once, by as many tasks as there are cores
    # however few files the catalogue has
    cells = _catalog_cells(catalog.repartition(cpu_count(catalog.sparkSession)), grid, payload, ra, dec, source_id)
    if fine is None:
        return cells, None, None
    cells = reliable_checkpoint(cells)
    keys = cells.groupBy("_zone", "_bucket").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > dense).select("_zone", "_bucket")
    inside = cells.join(keys, ["_zone", "_bucket"], "left_semi").drop("_zone", "_bucket")
    # a source stands in several cells, of which more than one may be dense
    sources = inside.distinct()
    finer = _catalog_cells(sources, fine, payload, "_cra", "_cdec", "source_id")
    return cells.join(keys, ["_zone", "_bucket"], "left_anti"), finer, keys


def _finer(radius_arcsec: float, min_zone_arcsec: float) -> _Grid | None:
    """The grid with the smallest cells for a radius; None where the usual one is hardly larger."""
    usual, least = zone_height_deg(radius_arcsec, min_zone_arcsec), 2.0 * radius_arcsec / 3600.0
    return _Grid(radius_arcsec, 2.0 * radius_arcsec) if least <= 0.75 * usual else None


def cone_pairs(alerts: DataFrame, catalog: DataFrame, radius_arcsec: float, id_col: str = "candid",
               ra: str = "ra", dec: str = "dec", cat_ra: str = "ra", cat_dec: str = "dec",
               source_id: str = "source_id", payload: Sequence[str] = (),
               min_zone_arcsec: float = MIN_ZONE_ARCSEC) -> DataFrame:
    """All (alert, source) pairs within ``radius_arcsec``: ``id, source_id, sep_arcsec, payload...``."""
    grid, fine = _Grid(radius_arcsec, min_zone_arcsec), _finer(radius_arcsec, min_zone_arcsec)
    z, b = grid.alert_key(_c(ra), _c(dec))
    spot = [_c(id_col).alias("_id"), _c(ra).alias("_ara"), _c(dec).alias("_adec")]
    left = alerts.select(*spot, z.alias("_zone"), b.alias("_bucket"))
    cells, finer, keys = _split_dense(catalog, grid, fine, payload, cat_ra, cat_dec, source_id, DENSE)
    j = left.join(cells, ["_zone", "_bucket"], "inner")
    if finer is not None:
        z, b = fine.alert_key(F.col("_ara"), F.col("_adec"))
        in_dense = left.join(keys, ["_zone", "_bucket"], "left_semi").withColumns({"_zone": z, "_bucket": b})
        j = j.unionByName(in_dense.join(finer, ["_zone", "_bucket"], "inner"))
    sep = haversine_deg(F.col("_ara"), F.col("_adec"), F.col("_cra"), F.col("_cdec")) * F.lit(3600.0)
    return (
        j.select(F.col("_id").alias(id_col), "source_id", sep.alias("sep_arcsec"), *payload)
        .where(F.col("sep_arcsec") <= F.lit(float(radius_arcsec)))
    )


def cone_match(
    alerts: DataFrame,
    catalog: DataFrame,
    radius_arcsec: float,
    payload: Sequence[str],
    out_col: str,
    id_col: str = "candid",
    ra: str = "ra",
    dec: str = "dec",
    cat_ra: str = "ra",
    cat_dec: str = "dec",
    source_id: str = "source_id",
    unknown: str | None = None,
    broadcast_rows: int = DEFAULT_BROADCAST_ROWS,
    min_zone_arcsec: float = MIN_ZONE_ARCSEC,
    strategy: str = "auto",
) -> DataFrame:
    """Left cone join keeping the nearest source (ties: smallest source id).

    Adds ``out_col`` (the payload column, or a struct of several; ``unknown``
    fills unmatched single-column labels) and ``<out_col>_source_id``.
    """
    payload = list(payload)
    grid = _Grid(radius_arcsec, min_zone_arcsec)
    r = float(radius_arcsec)
    if strategy == "auto":
        strategy = "broadcast" if catalog_fits_broadcast(catalog, broadcast_rows, None, payload) else "shuffle"

    if strategy == "broadcast":
        # the arrays together are the catalogue and its copies, whose bytes have been checked
        fine = _finer(radius_arcsec, min_zone_arcsec)
        cells, finer, _ = _split_dense(catalog, grid, fine, payload, cat_ra, cat_dec, source_id, DENSE)
        j = alerts
        for g, part, name in ((grid, cells, "_cands"), (fine, finer, "_near")):
            if part is None:
                j = j.withColumn(name, F.lit(None).cast(j.schema["_cands"].dataType))
                continue
            arr = part.groupBy("_zone", "_bucket").agg(F.collect_list(F.struct("_cra", "_cdec", "source_id", *payload)).alias(name))
            z, b = g.alert_key(_c(ra), _c(dec))
            j = j.withColumn("_zone", z).withColumn("_bucket", b).join(F.broadcast(arr), ["_zone", "_bucket"], "left").drop("_zone", "_bucket")
        ara, adec = _c(ra), _c(dec)
        scored = F.transform(
            F.concat(F.coalesce(F.col("_cands"), F.array()), F.coalesce(F.col("_near"), F.array())),
            lambda c: F.struct(
                (haversine_deg(ara, adec, c["_cra"], c["_cdec"]) * F.lit(3600.0)).alias("sep_arcsec"),
                c["source_id"].alias("source_id"),
                *[c[p].alias(p) for p in payload],
            ),
        )
        best = F.array_min(F.filter(scored, lambda x: x["sep_arcsec"] <= F.lit(r)))
        out = j.withColumn("_best", best).drop("_cands", "_near")
    elif strategy == "shuffle":
        # the match depends on the position alone: matching each position once gives
        # every row its own result, also where ids repeat or are missing
        spots = alerts.select(_c(ra).alias("_pra"), _c(dec).alias("_pdec")).distinct().withColumn("_spot", F.struct("_pra", "_pdec"))
        pairs = cone_pairs(spots, catalog, r, "_spot", "_pra", "_pdec", cat_ra, cat_dec, source_id, payload,
                           min_zone_arcsec)
        bestp = pairs.groupBy("_spot").agg(F.min(F.struct("sep_arcsec", "source_id", *payload)).alias("_best")).select(
            F.col("_spot._pra").alias("_bra"), F.col("_spot._pdec").alias("_bdec"), "_best")
        out = alerts.join(bestp, (_c(ra) == F.col("_bra")) & (_c(dec) == F.col("_bdec")), "left").drop("_bra", "_bdec")
    else:
        raise ValueError(f"unknown strategy {strategy!r}")

    if len(payload) == 1:
        val = F.col(f"_best.{payload[0]}")
        if unknown is not None:
            val = F.coalesce(val, F.lit(unknown))
    else:
        val = F.when(F.col("_best").isNotNull(), F.struct(*[F.col(f"_best.{p}").alias(p) for p in payload]))
    return (
        out.withColumn(out_col, val)
        .withColumn(f"{out_col}_source_id", F.col("_best.source_id"))
        .withColumn(f"{out_col}_sep_arcsec", F.col("_best.sep_arcsec"))
        .drop("_best")
    )


def parse_columns(spec: str) -> list[str]:
    """Catalogue column list as written in module arguments: ``"a,b,c"``."""
    cols = [c.strip() for c in spec.split(",") if c.strip()]
    if not cols:
        raise ValueError("empty column list")
    return cols
