"""Whole plans: the aggregate tables, the reports over them, and the end-to-end run."""
