"""Numpy kernels for pixels, run inside Arrow batches by ``plans``."""
