"""Readers and writers (Parquet, CSV), fixtures derived from the given tables, model artifacts."""
