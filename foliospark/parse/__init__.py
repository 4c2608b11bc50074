"""Bytes to rows: the only Python layer over documents. Nothing here imports Spark."""
