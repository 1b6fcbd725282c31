"""DataFrame operators, one module per kind."""
