"""DataFrame operators of the graph engine."""
