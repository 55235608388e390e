"""Operators over a notes DataFrame."""
