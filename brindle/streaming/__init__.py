"""Structured Streaming over event tables: beyond what an interactive workbench offers."""
