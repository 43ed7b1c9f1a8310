"""Column functions and codec kernels."""
