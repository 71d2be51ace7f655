"""Imputation, hold-out forests, detection models and what is read off their output."""
