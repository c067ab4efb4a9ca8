"""The registered queries over the star tables, and their SQL for an independent engine."""
