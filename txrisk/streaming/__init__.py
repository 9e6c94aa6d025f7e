"""Structured Streaming forms of the stateless operators."""
