"""Readers and writers: columnar tables, message stores, contact cards and JSON lines."""
