"""Readers, writers and the task catalogue."""
