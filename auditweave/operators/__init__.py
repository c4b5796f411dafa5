"""operators of the audit engine."""
