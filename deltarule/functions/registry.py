"""Functions that programs call by name: SQL templates or Arrow-batched Python."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from deltarule.errors import RuleError


class Functions:
    """A registry. SQL functions cost nothing; Python ones run on Arrow batches and must be pure."""

    def __init__(self) -> None:
        self._sql: dict[str, tuple[tuple[str, ...], str, str]] = {}
        self._python: dict[str, tuple[Callable, str, bool]] = {}

    def sql(self, name: str, parameters: dict[str, str], returns: str, body: str) -> Functions:
        """A Spark SQL expression over typed parameters, expanded where it is called."""
        self._free(name)
        self._sql[name] = (tuple(f"{k} {v}" for k, v in parameters.items()), returns, body)
        return self

    def scalar(self, name: str, returns: str) -> Callable[[Callable], Callable]:
        """Decorator for a function of Python values."""
        return self._decorator(name, returns, False)

    def vectorised(self, name: str, returns: str) -> Callable[[Callable], Callable]:
        """Decorator for a function of pandas series."""
        return self._decorator(name, returns, True)

    def _decorator(self, name: str, returns: str, vectorised: bool) -> Callable[[Callable], Callable]:
        self._free(name)

        def keep(function: Callable) -> Callable:
            self._python[name] = (function, returns, vectorised)
            return function

        return keep

    def _free(self, name: str) -> None:
        if name in self._sql or name in self._python:
            raise RuleError(f"function {name} is registered twice")

    def register(self, spark: SparkSession) -> None:
        for name, (parameters, returns, body) in self._sql.items():
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(parameters)}) RETURNS {returns} RETURN {body}")
        for name, (function, returns, vectorised) in self._python.items():
            spark.udf.register(name, F.pandas_udf(_series(function, vectorised), returns))


def _series(function: Callable, vectorised: bool) -> Callable:
    if vectorised:
        def batch(*columns: pd.Series) -> pd.Series:
            return function(*columns)
    else:
        def batch(*columns: pd.Series) -> pd.Series:
            return pd.Series([function(*row) for row in zip(*(c.tolist() for c in columns), strict=True)])

    return batch
