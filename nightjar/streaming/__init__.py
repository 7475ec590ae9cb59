"""Structured Streaming form of the causal epoch operators."""
