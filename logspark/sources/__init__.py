"""Readers: raw lines, event history, collector batches, dimension feeds."""
