"""Batch operators over record, log, entity and usage tables."""
