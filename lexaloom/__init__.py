"""Corpus analytics on Spark: page tables, retrieval, link graphs, quality rules and change feeds."""
