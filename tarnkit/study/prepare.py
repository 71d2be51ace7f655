"""Raw weather and sample tables to the analysis table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.functions.semantics import if_else3
from tarnkit.operators import cleaning, selectors
from tarnkit.operators.joins import lookup_join
from tarnkit.operators.timeseries import rolling
from tarnkit.study import names as N


def compile_weather(raw: DataFrame) -> DataFrame:
    """One row per station and date with the mean of each reading, April to December, and the region.

    The long form with one mean per parameter is a plain grouped average of each column here.
    """
    table = selectors.clean_names(raw)
    season = table.filter(F.col("month").cast("int").between(4, 12))
    readings = selectors.column_names(
        season, exclude=[*N.WEATHER_KEYS, selectors.any_of(N.WEATHER_UNUSED), selectors.contains("flag", "gust")]
    )
    means = season.groupBy(*N.WEATHER_KEYS).agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in readings])
    is_nb = F.col("station_name").contains(N.NEW_BRUNSWICK_STATION)
    return means.withColumn("region", if_else3(is_nb, F.lit("nb"), F.lit("ns")))


def trailing_weather(weather: DataFrame, by: str = "region", pieces: int | None = None) -> DataFrame:
    """Add 3- and 7-day precipitation sums and temperature means, then keep temperature and precipitation."""
    frames = {
        f"{label}_{k}d_{suffix}": (statistic, column, k)
        for label, suffix, statistic, column in (
            ("precip", "sum", "sum", "total_precip_mm"),
            ("temp", "mean", "mean", "mean_temp_c"),
            ("temp", "avgmax", "mean", "max_temp_c"),
        )
        for k in (7, 3)
    }
    rolled = rolling(weather, [by], "date_time", frames, pieces=pieces)
    return selectors.select_cols(rolled, "date_time", "region", selectors.contains("temp"), selectors.contains("precip"))


def label_sites(raw: DataFrame) -> DataFrame:
    """Region from the raw site name, then the site's result name."""
    region = F.when(F.col("location").isin(N.NEW_BRUNSWICK_SITES), "nb").otherwise("ns")
    return cleaning.recode_column(raw.withColumn("region", region), "location", N.SITE_LABELS)


def substitute_grab(samples: DataFrame) -> DataFrame:
    """Missing grab values come from solid-phase extraction; the extraction columns get their short names."""
    filled = samples.withColumn("grab_mclr", cleaning.prefer("grab_mclr", "spe_grab_mclr"))
    filled = selectors.rename(filled, {"spe_mclr": "spe_grab_mclr", "spe_mclr_lod": "spe_grab_mclr_lod"})
    return selectors.relocate(filled, *N.TOXINS, after="sample_time")


def analysis_table(raw: DataFrame, weather: DataFrame, threshold: float = 0.4) -> DataFrame:
    """The cleaned table: labelled sites, filled grab values, weather of the day, sparse columns dropped.

    ``weather`` is unique per (date_time, region); a repeated key would multiply samples and is an error.
    """
    samples = substitute_grab(label_sites(raw))
    measured = selectors.column_names(
        samples,
        exclude=["location", "sample_date", "region", selectors.any_of(["id", "sample", "sample_time"]),
                 selectors.contains("rdl", "ul_", "lod")],
    )
    sparse = cleaning.sparse_columns(samples, measured, threshold, exempt="spe")
    cleaning.verify_unique(weather, ["date_time", "region"])
    joined = lookup_join(samples, weather, {"sample_date": "date_time", "region": "region"}, "left", null_safe=True)
    dropped = selectors.column_names(joined, selectors.contains(*sparse)) if sparse else []
    table = joined.drop(*dropped, "dn", "region")
    for part in ("ul_", "lod", "rdl"):
        table = selectors.relocate(table, selectors.contains(part), last=True)
    return table.filter(F.col("location").isin(N.STUDY_SITES))
