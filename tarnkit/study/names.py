"""Names in the study's files. They must match the input data and its published tables."""

from __future__ import annotations

# Site names in the raw table and the names used in results.
SITE_LABELS = {
    "Banook 1": "Lake Banook 1",
    "Banook 2": "Lake Banook 2",
    "Fairbanks": "Shubenacadie Canal",
    "Penhorn": "Penhorn Lake",
    "Shubie 1": "Lake Charles 1",
    "Shubie 2": "Lake Charles 2",
    "Collins Park": "Lake Fletcher",
    "Kearney": "Kearney Lake",
    "Cunard": "Cunard Pond",
    "Tower Road": "Tower Road Reservoir",
    "Turtle Creek": "Turtle Creek Reservoir",
    "INP": "INP",
}
SHORT_LABELS = {
    "Shubenacadie Canal": "SC",
    "Tower Road Reservoir": "TRR",
    "Turtle Creek Reservoir": "TCR",
}
NEW_BRUNSWICK_SITES = ["INP", "Tower Road", "Turtle Creek"]
STUDY_SITES = list(SITE_LABELS.values())
NEW_BRUNSWICK_STATION = "MONCTON"

# Column names.
WEATHER_KEYS = ["station_name", "date_time"]
WEATHER_UNUSED = [
    "longitude_x", "latitude_y", "climate_id", "year", "month", "day", "data_quality",
    "snow_on_grnd_cm", "total_rain_mm", "total_snow_cm",
]
CHEMISTRY = ["p_ugl", "chloride_mgl", "tn_ugl", "colour", "doc_mgl", "toc_mgl"]
TABLE_COLUMNS = ["chloride_mgl", "colour", "p_ugl", "ph_field", "tn_ugl", "toc_mgl", "total_cyano"]
WATER = [
    "temp_field", "do_field", "cond_field", "ph_field", "tds_field", "al", "p", "fe", "chloride", "nitrate",
    "sulfate", "uv_254", "turbidity", "colour", "doc", "toc", "tn",
]
GENES = ["cyra", "mcye_ndaf", "sxta", "total_cyano"]
WEATHER = [
    "max_temp_c", "min_temp_c", "mean_temp_c", "temp_7d_mean", "temp_3d_mean", "temp_7d_avgmax", "temp_3d_avgmax",
    "total_precip_mm", "precip_7d_sum", "precip_3d_sum",
]
TOXINS = ["grab_mclr", "passive_mclr", "spe_mclr"]
FOREST_FEATURES = [
    *WATER, "mcye_ndaf", "total_cyano", *WEATHER, "tn_tp_ratio", "lag_mcye", "lag_tc",
]
SCALED = ["week_of_year", "mcye", "lag_mcye", "tds_field", "cond_field", "chloride", "uv_254", "colour", "precip_7d_sum"]
