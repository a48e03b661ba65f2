"""Catalog of datasets, file formats."""
