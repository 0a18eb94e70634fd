"""Column builders: distances, kernels and screens."""
