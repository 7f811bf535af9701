"""Writes, version resolution, reads, schemas, snapshots, queues and ranges."""
