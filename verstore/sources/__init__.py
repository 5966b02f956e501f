"""Readers and writers of the binary interchange formats, and adapters."""
