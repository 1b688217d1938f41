"""Readers, writers and typed staging projections."""
