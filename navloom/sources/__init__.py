"""Readers, landed-payload parsers, sinks and the adapters for the test tables."""
