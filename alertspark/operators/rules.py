"""Rule-based per-alert flags (asteroid association code).

Pure column expressions: no shuffle, no Python; they stay in the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed thresholds of the asteroid rules.
STAR_SGSCORE = 0.76
STAR_DISTPSNR = 1.0
KNOWN_SSO_ARCSEC = 5.0
DEFAULT_MAX_GAP_DAYS = 0.0208


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def detection_times(cjd="cjd", cmagpsf="cmagpsf") -> Column:
    """Times of the detections (elements whose magnitude is not NULL), in order."""
    mag = _c(cmagpsf)
    return F.filter(_c(cjd), lambda x, i: F.element_at(mag, i + 1).isNotNull())


def asteroid_flag(
    cjd="cjd",
    cmagpsf="cmagpsf",
    ndethist="candidate.ndethist",
    sgscore1="candidate.sgscore1",
    ssdistnr="candidate.ssdistnr",
    distpsnr1="candidate.distpsnr1",
    max_gap_days: float = DEFAULT_MAX_GAP_DAYS,
) -> Column:
    """Association code: 3 known object near, 2 new two-detection mover, 1 single detection, 0 none.

    The first rule that holds wins; a NULL input never yields 2 or 3.
    """
    star = (_c(sgscore1) > F.lit(STAR_SGSCORE)) & (_c(distpsnr1) < F.lit(STAR_DISTPSNR))
    not_star = ~star
    det = detection_times(cjd, cmagpsf)
    gap = F.when(F.size(det) >= 2, F.try_element_at(det, F.lit(-1)) - F.try_element_at(det, F.lit(-2)))
    nd = _c(ndethist)
    sd = _c(ssdistnr)
    return (
        F.when((sd >= F.lit(0.0)) & (sd < F.lit(KNOWN_SSO_ARCSEC)), F.lit(3))
        .when((nd == 2) & not_star & (gap <= F.lit(float(max_gap_days))), F.lit(2))
        .when((nd == 1) & not_star, F.lit(1))
        .otherwise(F.lit(0))
        .cast("int")
    )
