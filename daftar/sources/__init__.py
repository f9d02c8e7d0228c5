"""Scans and sinks: reads, labels, images, weights, and drawn test material."""
