"""Operators for large training-data pipelines (self-contained; nothing else imports it)."""
