"""Recursive rules on Spark: typed relations, rules and fixed points as DataFrames."""

from deltarule.errors import RuleError
from deltarule.functions.registry import Functions
from deltarule.pipeline import Pipeline, default_pipeline
from deltarule.program import Program, Results

__all__ = ["Functions", "Pipeline", "Program", "Results", "RuleError", "default_pipeline"]
