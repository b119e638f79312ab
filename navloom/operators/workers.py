"""User functions per key."""

from __future__ import annotations

from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F


def run_per_key(keys: DataFrame, key: str, process: Callable[[dict], str], retries: int = 0) -> DataFrame:
    """(key, status, error): process(row) of every row gives success, skip or fail; an exception is a fail.

    One row is one key, so work spreads over all tasks and no key gathers rows.
    """
    columns = keys.columns

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf[columns].to_dict("records"):
                status, error = "fail", None
                for _ in range(retries + 1):
                    try:
                        status, error = process(row), None
                        break
                    except Exception as exc:  # noqa: BLE001
                        error = str(exc)
                out.append((str(row[key]), status, error))
            yield pd.DataFrame(out, columns=[key, "status", "error"])

    return keys.mapInPandas(run, f"{key} string, status string, error string")


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))
