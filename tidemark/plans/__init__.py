"""Registered queries, by subject, each with the SQL that says the same."""
