"""sources of the quantloom engine."""
