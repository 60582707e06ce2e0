"""Composed pipelines (matching runs, full analyses) and registered queries."""
