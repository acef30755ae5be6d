"""streaming of the quantloom engine."""
