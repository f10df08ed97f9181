"""Readers and writers of binary formats."""
