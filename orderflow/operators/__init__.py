"""DataFrame -> DataFrame steps; each can be used with ``df.transform``."""
