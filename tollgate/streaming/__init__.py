"""Incremental drivers that feed the batch plans from a file stream."""
