"""Structured Streaming front end for file sources (cloud_storage objects).

The ingestion engine itself is batch: its "watermark" is a stored high-water
mark, not an event-time watermark.  For objects that arrive as files, a
stream with ``foreachBatch`` runs the same hash-merge on each micro-batch,
and the streaming checkpoint tracks which files are done.  Nothing else
here is streaming-specific.
"""

from sluice.streaming.file_merge import merge_stream

__all__ = ["merge_stream"]
