"""The incremental load driven by a file-source stream."""
