"""Subpackage `operators`."""
