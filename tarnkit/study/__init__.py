"""The monitoring study end to end: raw files to analysis table, reports, predictions and thresholds."""
