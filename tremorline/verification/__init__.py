"""Registered queries over the test tables, each with SQL for the same result where SQL
can say it."""
