"""Readers: timesheet exports and payloads, reference tables, documents, and the driver tables."""
