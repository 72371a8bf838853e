"""Pure kernels that run inside grouped functions: trees, reconciliation, islands, sequences."""
