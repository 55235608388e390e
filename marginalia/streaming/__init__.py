"""Streaming variants (an extension)."""
