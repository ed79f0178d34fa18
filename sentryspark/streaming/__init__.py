"""Structured Streaming forms of the detection and roll-up jobs."""
