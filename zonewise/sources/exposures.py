"""Exposure metadata held as rows of keys and values, and lookups of exposures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The keys that are kept, by the column that holds their value.
INTEGER_KEYS = ("NAXIS1", "NAXIS2", "LTV1", "LTV2", "A_ORDER", "B_ORDER", "AP_ORDER", "BP_ORDER")
DOUBLE_KEYS = (
    "EQUINOX", "EXPTIME", "FLUXMAG0", "FLUXMAG0ERR", "CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CDELT1", "CDELT2",
    "CD1_1", "CD1_2", "CD2_1", "CD2_2", "PC1_1", "PC1_2", "PC2_1", "PC2_2",
)
STRING_KEYS = ("RADESYS", "TIME-MID", "FILTER", "CUNIT1", "CUNIT2", "CTYPE1", "CTYPE2")
SIP_KEY = r"^[AB]P?_[0-9]+_[0-9]+$"


def exposures_from_rows(rows: DataFrame, id_column: str, tai_minus_utc: float = 0.0) -> DataFrame:
    """One row per exposure from (id, metadataKey, intValue, doubleValue, stringValue).

    Columns: the id, one for each kept key in lower case with - as _, sip (a map of the distortion's
    coefficients, lower-case), filter trimmed, and epoch: the MJD of TIME-MID, an ISO time in UTC, plus
    tai_minus_utc seconds. A key that occurs twice for an exposure is an error.
    """
    numbers = F.coalesce(F.col("doubleValue"), F.col("intValue").cast("double"))
    kept = rows.filter(F.col("metadataKey").isin(*INTEGER_KEYS, *DOUBLE_KEYS, *STRING_KEYS) | F.col("metadataKey").rlike(SIP_KEY))

    times = kept.groupBy(id_column, "metadataKey").agg(F.count(F.lit(1)).alias("__times"), *(F.first(c).alias(c) for c in ("intValue", "doubleValue", "stringValue")))
    once = F.when(F.col("__times") == 1, F.col("metadataKey")).otherwise(F.raise_error(F.concat(F.lit("an exposure has a key twice: "), F.col("metadataKey"))).cast("string"))
    kept = times.withColumn("metadataKey", once)
    columns = [F.max(F.when(F.col("metadataKey") == k, F.col("intValue"))).alias(k.lower()) for k in INTEGER_KEYS]
    columns += [F.max(F.when(F.col("metadataKey") == k, numbers)).alias(k.lower()) for k in DOUBLE_KEYS]
    columns += [F.max(F.when(F.col("metadataKey") == k, F.trim("stringValue"))).alias(k.lower().replace("-", "_")) for k in STRING_KEYS]
    pairs = F.collect_list(F.when(F.col("metadataKey").rlike(SIP_KEY), F.struct(F.lower("metadataKey").alias("k"), numbers.alias("v"))))
    made = kept.groupBy(id_column).agg(*columns, F.map_from_entries(F.array_sort(pairs)).alias("sip"))
    return made.withColumn("epoch", mjd_of_iso(F.col("time_mid"), tai_minus_utc))


def image_exposures(made: DataFrame, id_column: str, filters: Sequence[str]) -> DataFrame:
    """Exposures as the joins take them, from exposures_from_rows: exposure_id, filter_id, epoch, exptime, WCS, x0, y0, width, height, flux_mag0, flux_mag0_err, sip.

    Without any CD key, the matrix is PC (the identity where missing) times CDELT (1 where missing);
    with one, the missing ones are 0. x0 and y0 are -LTV, 0 where missing. A zero point that is not
    positive, a negative error of one, and a filter that is not in ``filters``, are errors; a missing
    error is 0.
    """

    def fine(value: Column, test: Column, message: str) -> Column:
        return F.when(value.isNull() | test, value).otherwise(F.raise_error(F.lit(message)).cast("double"))

    any_cd = F.coalesce("cd1_1", "cd1_2", "cd2_1", "cd2_2").isNotNull()
    matrix = {}
    for i in (1, 2):
        for j in (1, 2):
            turned = F.coalesce(f"pc{i}_{j}", F.lit(1.0 if i == j else 0.0)) * F.coalesce(f"cdelt{i}", F.lit(1.0))
            matrix[f"cd{i}_{j}"] = F.when(any_cd, F.coalesce(f"cd{i}_{j}", F.lit(0.0))).otherwise(turned)
    place = F.array_position(F.array(*(F.lit(f) for f in filters)), F.col("filter"))
    filter_id = F.when(F.col("filter").isNull(), F.lit(None).cast("int")).when(place > 0, (place - 1).cast("int")).otherwise(F.raise_error(F.lit("an exposure has an unknown filter")).cast("int"))
    zero, error = F.col("fluxmag0"), F.col("fluxmag0err")
    return made.select(
        F.col(id_column).alias("exposure_id"), filter_id.alias("filter_id"), "epoch", "exptime", "crval1", "crval2", "crpix1", "crpix2", *(c.alias(n) for n, c in matrix.items()),
        F.coalesce(-F.col("ltv1"), F.lit(0)).alias("x0"), F.coalesce(-F.col("ltv2"), F.lit(0)).alias("y0"), F.col("naxis1").alias("width"), F.col("naxis2").alias("height"),
        fine(zero, zero > 0, "a zero point is not positive").alias("flux_mag0"), F.when(zero.isNotNull(), F.coalesce(fine(error, error >= 0, "a zero point's error is negative"), F.lit(0.0))).alias("flux_mag0_err"), "sip",
    )


def mjd_of_iso(text, tai_minus_utc: float = 0.0):
    """The MJD of an ISO time; a time zone in the text counts, without one it is UTC (the session's zone).

    One division and one sum are less than half a microsecond off up to 2038 (MJD 65536), so iso_of_mjd
    gives the same microsecond back.
    """
    micros = F.unix_micros(F.to_timestamp(F.rtrim(text))) + round(tai_minus_utc * 1_000_000)
    return micros / 864e8 + 40587


def iso_of_mjd(mjd, tai_minus_utc: float = 0.0):
    """An ISO time in UTC, with microseconds."""
    day = F.floor(mjd)
    # a day's fraction is exact, and so small that its microseconds are
    micros = (day - 40587) * 86_400_000_000 + F.round((mjd - day) * 864e8).cast("bigint") - round(tai_minus_utc * 1_000_000)
    return F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def with_exposure(sources: DataFrame, exposures: DataFrame, columns: list[str]) -> DataFrame:
    """``sources`` with columns of their exposure (exposure_id); an exposure that is missing, or there twice, is an error."""
    once = exposures.groupBy("exposure_id").agg(F.count(F.lit(1)).alias("__times"), *(F.first(c).alias(c) for c in columns))
    met = sources.join(once, "exposure_id", "left")
    fine = F.when(F.col("__times") == 1, F.col("exposure_id")).otherwise(F.raise_error(F.lit("a source's exposure is missing or not unique")).cast(sources.schema["exposure_id"].dataType))
    return met.withColumn("exposure_id", fine).drop("__times")
