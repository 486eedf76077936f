"""Readers and writers: ledger tables, recogniser documents, timelines, audio files."""
