"""Files of documents and messages: readers and writers on Spark's own text and binary sources, and data sources."""

from compactcodec.sources.files import read_big_table, read_documents, read_messages, read_tables, write_messages, write_tables
from compactcodec.sources.datasource import register

__all__ = ["read_big_table", "read_documents", "read_messages", "read_tables", "register", "write_messages", "write_tables"]
