"""Readers: files, tables, documents and the planning tables of the test data."""
