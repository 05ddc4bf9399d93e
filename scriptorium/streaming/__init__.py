"""The batch operators as Structured Streaming jobs."""
