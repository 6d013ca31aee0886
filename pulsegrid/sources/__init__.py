"""Readers and writers of recordings."""
