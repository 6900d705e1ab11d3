"""Readers and writers of vectors, journals and snapshots."""
