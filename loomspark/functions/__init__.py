"""Registries of scalar and normalisation functions."""
