"""Operators for preparing large text collections; nothing else in the package imports this."""
