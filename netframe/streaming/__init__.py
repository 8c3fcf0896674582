"""Graph aggregates over streams of edges."""
