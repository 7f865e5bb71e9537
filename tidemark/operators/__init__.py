"""Tidemark operators."""
