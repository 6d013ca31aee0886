"""Column helpers and small numeric kernels."""
