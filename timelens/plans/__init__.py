"""Driver-side planning: what a question needs, and typed aggregation requests."""
