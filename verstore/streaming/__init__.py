"""Change-log tailing with Structured Streaming."""
