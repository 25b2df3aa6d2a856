"""Row-wise operators applied to Structured Streaming sources."""
