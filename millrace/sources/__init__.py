"""Readers and writers: delimited text, JSON, SQL tables, workbooks, typed binary tables, files."""
