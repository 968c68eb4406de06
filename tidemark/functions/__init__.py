"""Column functions. Every one is a Catalyst expression; there are no Python UDFs."""
