"""Operators of a training-data pipeline: extraction, scoring, formatting,
packing, deduplication, search and encoding.

Each module holds one operator with its own general interface; ``queries``
registers the thin ``opN_<name>`` queries and their SQL. Nothing else in the
package imports this subpackage.
"""
