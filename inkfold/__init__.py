"""Corpus-scale OCR quality analytics on Spark DataFrames."""
