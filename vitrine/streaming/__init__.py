"""Change feeds with Structured Streaming."""
