"""Readers and writers: archive files, partitioned tables, mapped sample tables."""
