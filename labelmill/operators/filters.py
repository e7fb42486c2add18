"""Row filters over the metadata table. All of them reach the scan as pushed filters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.config import CorpusConfig, needed_years


def by_ipc(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(F.col("main_ipcr_label").startswith(prefix))


def by_cpc(df: DataFrame, prefix: str) -> DataFrame:
    return df.where(F.col("main_cpc_label").startswith(prefix))


def by_classification(df: DataFrame, ipc: str | None = None, cpc: str | None = None) -> DataFrame:
    """The IPC prefix wins when both are given."""
    if ipc:
        return by_ipc(df, ipc)
    return by_cpc(df, cpc) if cpc else df


def matching(df: DataFrame, expression: str | None) -> DataFrame:
    """Any boolean SQL expression over the metadata columns."""
    return df.where(expression) if expression else df


def date_literal(bound: str) -> Column:
    """An ISO date, zero padding optional, at midnight."""
    return F.lit(bound).cast("date").cast("timestamp_ntz")


def filed_between(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Filing date within ``[start, end]``, each bound optional."""
    if start:
        df = df.where(F.col("filing_date") >= date_literal(start))
    if end:
        df = df.where(F.col("filing_date") <= date_literal(end))
    return df


def year_spans(years: Iterable[int]) -> list[tuple[int, int]]:
    """Consecutive years joined to ``(first, last)`` spans."""
    spans: list[tuple[int, int]] = []
    for year in sorted(set(years)):
        if spans and year == spans[-1][1] + 1:
            spans[-1] = (spans[-1][0], year)
        else:
            spans.append((year, year))
    return spans


def in_years(df: DataFrame, years: Iterable[int]) -> DataFrame:
    """Rows filed in one of ``years``, a time on 31 December included.

    On a table partitioned by ``filing_year`` this prunes partitions. Elsewhere it is a few
    half-open ranges on ``filing_date``, which the Parquet scan can use, unlike ``year(...)``.
    """
    years = list(years)
    if "filing_year" in df.columns:
        return df.where(F.col("filing_year").isin(years))
    if not years:
        return df.where(F.lit(False))
    ranges = (
        (F.col("filing_date") >= date_literal(f"{first}-01-01"))
        & (F.col("filing_date") < date_literal(f"{last + 1}-01-01"))
        for first, last in year_spans(years)
    )
    return df.where(reduce(lambda a, b: a | b, ranges))


def config_years(config: CorpusConfig) -> list[int] | None:
    """Years whose partitions are read: those asked for, else those the windows touch; None: all."""
    return list(config.years) if config.years is not None else needed_years(config)


def select_metadata(df: DataFrame, config: CorpusConfig) -> DataFrame:
    """Classification, expression and year filters of a configuration. Only years that are asked for are a row filter."""
    df = by_classification(df, config.ipc_prefix, config.cpc_prefix)
    df = matching(df, config.query)
    return df if config.years is None else in_years(df, list(config.years))


def keep_decided(df: DataFrame, label: str = "labels") -> DataFrame:
    """Drop pending and continuation filings."""
    return df.where(F.col(label) <= 1)


def count_by_year(df: DataFrame) -> DataFrame:
    return df.groupBy(F.year("filing_date").alias("filing_year")).agg(F.count("*").alias("n"))
