"""Byte layouts of values, tuples, pages, log records and files. Pure functions; operators map them over batches."""
