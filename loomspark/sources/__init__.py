"""Readers, writers and the catalogue of named tables."""
