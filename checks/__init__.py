"""Queries over the driver's tables, with a SQL oracle for each."""
