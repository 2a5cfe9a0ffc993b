"""Probe-side filtering analytics, written for Spark's DataFrame API."""
