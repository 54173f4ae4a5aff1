"""Readers and writers: CSV folders, Parquet store, triples, audit log, order tables."""
