"""Readers and writers: landed statements, stage tables, the index with its shards, and the demo adapter."""
