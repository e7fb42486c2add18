from labelmill.sources.arrow_index import index_batches, read_indexed
from labelmill.sources.by_name import looked_up, read_documents_by_name
from labelmill.sources.documents import ingest_documents, quarantine, read_documents, write_documents
from labelmill.sources.metadata import list_columns, read_arrow, read_metadata, split_unreadable, write_arrow

__all__ = [
    "index_batches",
    "ingest_documents",
    "list_columns",
    "looked_up",
    "quarantine",
    "read_arrow",
    "read_documents",
    "read_documents_by_name",
    "read_indexed",
    "read_metadata",
    "split_unreadable",
    "write_arrow",
    "write_documents",
]
