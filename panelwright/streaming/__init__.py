"""Event-log operators as Structured Streaming, each with its batch equivalent."""
