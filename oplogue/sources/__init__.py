"""Readers and writers of logs, lists, receipts and metrics."""
