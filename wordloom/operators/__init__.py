"""DataFrame operators, batched over queries."""
