"""All queries but those of the optional subpackage, which adds its own."""

from tidewater.plans import functions, joins, learning, models, profile, series
from tidewater.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "functions", "joins", "learning", "models", "profile", "series"]
