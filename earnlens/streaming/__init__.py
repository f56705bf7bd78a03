"""Structured Streaming: drift monitors (DRF-04..09) and streaming scoring."""
