"""Correcting files as they arrive."""
