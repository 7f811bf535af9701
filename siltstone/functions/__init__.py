"""Merge operators."""
