"""Subpackage `sources`."""
