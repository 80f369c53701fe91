"""Structured Streaming: windows, deduplication, run progress, incremental indexing.

Every transformation takes a DataFrame, streaming or not; on a batch it gives the final state of the stream.
"""
