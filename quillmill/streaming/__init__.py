"""Subpackage `streaming`."""
