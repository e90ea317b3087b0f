"""Readers of tables and the persistent store."""
