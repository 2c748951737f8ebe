"""Readers of price files, odds and score documents, feeds; and idempotent sinks."""
