"""Whole plans: bindings to tables, registered queries, pipelines."""
