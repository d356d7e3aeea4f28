"""Contract validation and resume on Structured Streaming."""
