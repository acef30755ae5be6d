"""plans of the quantloom engine."""
