"""Byte-level functions: checksums and their combination."""
