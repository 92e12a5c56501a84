"""Named analyses, and the full run over one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from quillframe.operators import analytics, charts, features, profile, stats, timeseries

ANALYSES = {
    "kpis": analytics.kpis,
    "cohort": analytics.cohort_retention,
    "funnel": analytics.funnel,
    "group_aggregate": analytics.group_aggregate,
    "correlation": stats.deep_correlation,
    "outlier_summary": stats.outlier_summary,
    "profile": profile.profile_dataset,
    "trend": timeseries.trend,
    "segment": analytics.segment,
}


def analyze(df: DataFrame, analysis_type: str, **config) -> DataFrame:
    """Run one of the nine analyses by name."""
    if analysis_type not in ANALYSES:
        raise ValueError(f"unknown analysis {analysis_type!r}; use one of {sorted(ANALYSES)}")
    return ANALYSES[analysis_type](df, **config)


def run_full(df: DataFrame, key: Sequence[str], date_col: str | None = None) -> dict[str, DataFrame]:
    """Profile, features, anomalies, KPIs, charts and findings of one table.

    Building the tables runs jobs: types, bounds and quantiles are found first, and ordered tables are written.
    """
    enriched, _ = features.engineer(df)
    return {
        "schema": profile.infer_schema(df, key),
        "quality": profile.quality_score(df),
        "missing": profile.missing_report(df),
        "summary": profile.summary_stats(df),
        "distribution": profile.distribution(df),
        "correlations": stats.correlation_matrix(df),
        "features": enriched,
        "anomalies": stats.anomaly_report(df, key),
        "kpis": analytics.kpis(df, date_col=date_col),
        "charts": charts.dashboard_data(df, key),
        "findings": analytics.insight_findings(df, date_col=date_col),
    }
