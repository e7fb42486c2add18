from labelmill.streaming.prepare import ingest_stream, prepare_stream

__all__ = ["ingest_stream", "prepare_stream"]
