"""Workloads, statistics, and the catalogue of queries with their SQL."""
