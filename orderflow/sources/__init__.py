"""Readers, the table layout on storage, and the export."""
