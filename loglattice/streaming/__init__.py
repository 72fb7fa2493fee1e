"""Live queries over Structured Streaming sources."""
