"""Stored mutation logs and manifests."""
