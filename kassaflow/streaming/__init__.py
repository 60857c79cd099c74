"""Bounded streams: the aggregations and the message store as micro-batches with checkpoints."""
