"""Operators for large text corpora: sharding, deduplication, encoding, scoring and scans.

Nothing outside this subpackage imports it. Every operator takes a DataFrame and column names, reads only
the columns it names, and keeps its working columns under names of its own, so that further columns of the
input, whatever they are called, do not matter.
"""
