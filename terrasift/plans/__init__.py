"""Queries composed of the operators, and the SQL that gives their rows."""
