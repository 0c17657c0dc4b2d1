"""Plan building blocks: skew-safe ordered scans and lineage control."""
