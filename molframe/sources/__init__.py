"""Readers, sinks and shard bookkeeping."""
