"""Spark-first analytics over gridded forecasts, voyages and text corpora."""
