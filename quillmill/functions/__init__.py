"""Subpackage `functions`."""
