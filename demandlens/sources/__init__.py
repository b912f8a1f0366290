"""Readers, writers and the test-data panel."""
