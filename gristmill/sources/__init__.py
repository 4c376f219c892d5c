"""Readers and writers: panels, prior records, reports."""
