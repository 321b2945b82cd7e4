"""PySpark-native analysis of tabular data: validate, profile, audit, model, explain, score."""

from tabwright.operators.profile import Profile
from tabwright.plans.pipeline import run

__all__ = ["Profile", "run"]
