"""Cohort time-series analytics on Spark."""
