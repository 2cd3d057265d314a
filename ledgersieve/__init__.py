"""Quality review and reconciliation of wide delimited extracts, as Spark DataFrame jobs."""

__version__ = "0.1.0"
