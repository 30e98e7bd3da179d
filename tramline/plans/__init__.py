"""Tramline plans."""
