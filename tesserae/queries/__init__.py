"""Queries over the synthetic tables, each with SQL that another engine can run for the same rows."""
