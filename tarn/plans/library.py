"""Imports every module that registers plans."""

from tarn.plans import classify, configs, graphs, lives, packages, relations, series  # noqa: F401
from tarn.plans.catalog import oracle_sql, queries  # noqa: F401
