"""Relational operators on reads, boxes and frames: joins, windows and aggregates only."""
