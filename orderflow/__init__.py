"""orderflow: a retail order-line pipeline and its reports, as Spark DataFrame functions."""

__version__ = "0.1.0"
