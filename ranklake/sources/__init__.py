"""Readers, parsers and writers of result documents and registers."""
