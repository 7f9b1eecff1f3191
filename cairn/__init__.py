"""Catalog analytics on Spark: browse, storage, duplicates, similarity, integrity, findings and plans."""
