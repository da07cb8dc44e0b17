"""plans of the graph engine."""
