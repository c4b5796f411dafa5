"""functions of the audit engine."""
