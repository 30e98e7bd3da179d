"""Tramline sources."""
