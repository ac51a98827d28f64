"""Tabular diagnostics on Spark: read a table, type its columns, report data quality,
clean it by explicit plans and analyse it, all as DataFrame jobs."""
