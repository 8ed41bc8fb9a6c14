"""Composed jobs: each wires several operators into one Spark plan."""
