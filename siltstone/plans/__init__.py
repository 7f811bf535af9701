"""Distributed scan plans."""
