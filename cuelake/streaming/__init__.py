"""Polls of streams over time: alerts on what changed, as a batch and as a stream."""
