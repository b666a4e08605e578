"""Readers and writers of transcripts, catalogs, logs, lexicons and indexes."""
