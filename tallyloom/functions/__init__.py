"""Column functions: plain ``Column -> Column`` helpers, no Python UDFs."""
