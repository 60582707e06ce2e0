"""Readers, sinks and fixture mappings."""
