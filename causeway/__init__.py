"""Causal time-series and risk analytics expressed as Spark DataFrame transforms."""
