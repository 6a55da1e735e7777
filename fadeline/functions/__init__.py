"""Column functions: array kernels, labels, numeric guards."""
