"""Column functions: wire format, addresses, safety and status."""
