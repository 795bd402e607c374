"""Change capture and Structured Streaming."""
