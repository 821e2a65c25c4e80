"""Column functions: text in, columns out; nothing here reads a table."""
