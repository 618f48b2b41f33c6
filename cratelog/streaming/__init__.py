"""Live capture as Structured Streaming."""
