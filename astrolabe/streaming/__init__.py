"""Streaming.

The reference has no unbounded sources, event time, watermarks or state: its
only line-at-a-time reader is a bounded scan with a row cap (S5, in
``astrolabe.sources.io.read_capped_valid``).  No streaming operator is
registered.  The DataFrame -> DataFrame operators here are stateless per row
or aggregate-based, so they can be applied inside ``foreachBatch`` of a
Structured Streaming query without change if a caller needs that.
"""
