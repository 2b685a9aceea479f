"""Queries over the tables of the driver, and the same in SQL."""
