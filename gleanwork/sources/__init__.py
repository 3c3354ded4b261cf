"""Readers, writers and the versioned tables they share."""
