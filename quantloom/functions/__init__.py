"""functions of the quantloom engine."""
