"""Dashboard refresh: run any of the traffic questions again on the stored table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from accessloom.sources.tables import read_access

Panel = Callable[[DataFrame], DataFrame]


def refresh_panels(
    spark: SparkSession, path: str, panels: dict[str, Panel], *, split_save: str = "day", day
) -> dict[str, DataFrame]:
    """Results over the current period of the table as it is now."""
    access = read_access(spark, path, split_save=split_save, first=day)
    return {name: panel(access) for name, panel in panels.items()}


def panel_step(
    path: str, out: str, panels: dict[str, Panel], *, split_save: str = "day", day
) -> Callable[[DataFrame, int], None]:
    """An ``after`` step for micro-batches that rewrites the result of each panel."""
    def step(batch: DataFrame, number: int) -> None:
        results = refresh_panels(batch.sparkSession, path, panels, split_save=split_save, day=day)
        for name, result in results.items():
            result.write.mode("overwrite").parquet(f"{out}/{name}")

    return step
