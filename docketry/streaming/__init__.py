"""Streams of submissions and results; each has a batch twin with the same rows."""
