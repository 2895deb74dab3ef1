"""Query text and named queries."""
