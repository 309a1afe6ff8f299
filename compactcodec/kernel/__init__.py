"""Codecs on plain Python values; they run inside Arrow-batched functions on the executors."""
