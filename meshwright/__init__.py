"""Meshwright: planning radio mesh networks over terrain with Spark queries."""
