"""Readers and writers of benchmark records."""
