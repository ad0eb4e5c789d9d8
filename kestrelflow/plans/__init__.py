"""Whole queries over the test tables, with SQL for the same results."""
