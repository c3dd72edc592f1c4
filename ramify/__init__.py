"""Hierarchy analytics on Spark: node tables in, labelled node tables and answers out."""
