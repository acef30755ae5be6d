"""operators of the quantloom engine."""
