"""Fixtures over the driver's tables, queries over the fixtures, and the SQL that they must equal."""
