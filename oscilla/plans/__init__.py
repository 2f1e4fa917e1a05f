"""Whole jobs that compose operators, sources and sinks."""
