"""Readers, writers, dimension tables and the views over the supplied tables."""
