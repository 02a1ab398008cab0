"""Readers and the versioned graph store."""
