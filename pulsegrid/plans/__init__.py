"""Whole analyses, and the registered queries with their SQL."""
