"""Imputation, hold-out forests, and thresholds from a detection model."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnkit.functions import censoring as C
from tarnkit.functions.dates import iso_week, iso_year
from tarnkit.functions.semantics import divide, in_order, interaction
from tarnkit.models import bootstrap, draws, forest, holdout, impute, importance, roc
from tarnkit.operators import cleaning, scaling
from tarnkit.operators.joins import keep_matching
from tarnkit.operators.selectors import any_of, column_names, contains
from tarnkit.operators.summaries import top_with_ties
from tarnkit.operators.timeseries import lags
from tarnkit.session import cut
from tarnkit.sources.tables import save_table
from tarnkit.study import names as N


def imputed_stack(table: DataFrame, key: str, imputations: int = 25, **options) -> DataFrame:
    """Completed predictor tables stacked by ``imp``, with responses and limits bound back by row key."""
    numbers = column_names(table, any_of([*N.WATER, *N.GENES, *N.WEATHER]))
    attached = column_names(table, "sample_date", any_of(N.TOXINS), contains("lod", "rdl", "ul_"))
    day = table.withColumn("_day", F.unix_date("sample_date"))
    options = {"bins": 64} | options
    stacked = impute.impute_multiple(day, key, numbers, ["location", "_day"], attached, imputations, **options)
    return stacked.drop("_day")


def forest_table(stacked: DataFrame, target: str = "passive_mclr") -> DataFrame:
    """Binary response, nutrient ratios, calendar columns, and the previous sample's gene levels."""
    derived = in_order(
        stacked,
        month=F.month("sample_date"),
        year=F.year("sample_date"),
        truth=C.detection_label(target, f"{target}_lod"),
        tn_tp_ratio=C.nitrogen_phosphorus("tn", "p"),
        tc_tn_ratio=C.carbon_nitrogen("toc", "tn"),
        tc_tp_ratio=C.carbon_phosphorus("toc", "p"),
    )
    return lags(derived, ["imp", "location"], "sample_date", {"lag_mcye": ("mcye_ndaf", 1), "lag_tc": ("total_cyano", 1)})


def study_holdouts(locations: Sequence[str], year: int = 2024, prefix: str = "full_test") -> list[holdout.Holdout]:
    """One hold-out for the year and one for each location."""
    slug = {name: name.lower().replace(" ", "_") for name in locations}
    return [holdout.Holdout(f"{prefix}_{year}", "year", year)] + [
        holdout.Holdout(f"{prefix}_{slug[name]}", "location", name) for name in locations
    ]


def forest_report(
    table: DataFrame, spec: forest.ForestSpec, holdouts: Sequence[holdout.Holdout], imputations: Sequence[int],
    row_id: str, path: str | None = None, tune: Mapping | None = None, min_threshold: float | None = None,
    min_detections: int = 0, top_n: int | None = None,
) -> dict[str, DataFrame]:
    """AUC summary, ROC bands and relative importance of all hold-out fits.

    The first sample of a site has no previous gene level; such rows cannot be predicted and are left out.
    ``tune`` (arguments of ``tune_holdouts``) chooses mtry and min_n for each hold-out on its own training rows and adds the
    table ``tuning``. ``min_threshold`` keeps larger thresholds of the curves only; ``min_detections`` reports AUC and
    curves of hold-outs with so many detections among their rows; ``top_n`` keeps each model type's best variables, with ties.
    """
    complete = table.dropna(subset=list(spec.features))
    chosen, found = None, {}
    if tune is not None:
        chosen, found["tuning"] = forest.tune_holdouts(complete, spec, holdouts, imputations, row_id, **tune)
    predictions, importances = forest.run_holdouts(complete, spec, holdouts, imputations, row_id, path=path, chosen=chosen)
    predictions = predictions if path is not None else cut(predictions)
    reported = predictions
    if min_detections:
        hits = predictions.groupBy("model", "imp").agg(F.count_if(F.col("truth") == spec.positive).alias("n"))
        enough = hits.groupBy("model").agg(F.min("n").alias("n")).filter(F.col("n") >= min_detections)
        reported = keep_matching(predictions, enough, "model")
    labels = {h.name: str(h.value) for h in holdouts if h.column == "location"}
    best = importance.importance_summary(importances)
    return found | {
        "predictions": predictions,
        "auc": roc.auc_summary(roc.auc(reported, positive=spec.positive), labels=labels),
        "roc": roc.roc_bands(roc.roc_curve(reported, positive=spec.positive, min_threshold=min_threshold)),
        "importance": best if top_n is None else top_with_ties(best, ["model_type"], "avg_importance", top_n),
    }


def model_table(table: DataFrame, scaled: Sequence[str] = N.SCALED) -> tuple[DataFrame, DataFrame]:
    """Rows for the detection model and the scaling constants of their columns.

    Genes below their limit are put at the limit and logged; censoring indicators keep the fact. Z-scores use
    all rows; rows without a passive result are dropped afterwards.
    """
    cleaning.verify_unique(table, ["location", "year", "week"])
    flagged = in_order(
        table,
        cens_mcye=C.censoring("mcye_ndaf", "lod_mcye_ndaf"),
        cens_total_cyano=C.censoring("total_cyano", "lod_total_cyano"),
        mcye=F.log10(C.at_least_limit("mcye_ndaf", "lod_mcye_ndaf")),
        total_cyano=F.log10(C.at_least_limit("total_cyano", "lod_total_cyano")),
        cens_ratio=F.when(F.col("mcye").isNull() | F.col("total_cyano").isNull(), "none").otherwise(F.col("cens_mcye")),
        ratio=divide("mcye", "total_cyano"),
        passive_mclr_binary=C.detection_label("passive_mclr", "passive_mclr_lod", 1, 0),
        isoyear=iso_year("sample_date"),
        week_of_year=iso_week("sample_date"),
        location_year=interaction("location", "year"),
    )
    columns = ["mcye", "total_cyano", "ratio", "cens_mcye", "cens_total_cyano"]
    lagged = lags(
        flagged, ["location"], "sample_date",
        {(f"cens_lag_{c[5:]}" if c.startswith("cens_") else f"lag_{c}"): (c, 1) for c in columns},
    )
    lagged = cleaning.fill_nulls(lagged, {"cens_lag_mcye": "none", "cens_lag_total_cyano": "none"})
    lagged = cut(lagged)
    constants = scaling.scaling_constants(lagged, list(scaled))
    scored = scaling.zscores(lagged, list(scaled))
    return scored.filter(F.col("passive_mclr_binary").isNotNull()), constants


def threshold_curves(
    rows: DataFrame, constants: DataFrame, key: str, replicates: int = 4000, weeks: int = 40, levels: int = 200,
    targets: Sequence[float] = draws.TARGETS, path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Threshold summary and mean probabilities over the grid of every location and year in the data."""
    found = bootstrap.bootstrap_coefficients(
        rows, key, F.col("passive_mclr_binary"), "location", "year", "week_of_year", "s_mcye", replicates
    )
    known = rows.filter(F.col("s_mcye").isNotNull())
    grid = draws.prediction_grid(known, ["location", "year"], {"week": ("week_of_year", weeks), "s_mcye": ("s_mcye", levels)})
    table = bootstrap.draws_of(found, grid, "location", "year", "week", "s_mcye")
    table = scaling.undo_scaling(table, "x", constants, "mcye", "x")
    if path is not None:
        table = save_table(table, path, ["location", "year"])
    return draws.threshold_summary(draws.crossing_points(table, targets=targets)), draws.mean_draws(table)
