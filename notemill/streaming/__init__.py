"""Stateful monitors of live run histories."""
