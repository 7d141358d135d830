"""Readers: parquet tables, documents, pages, transcripts and folders."""
