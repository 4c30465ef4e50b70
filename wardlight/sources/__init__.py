"""Schemas, readers, writers and keyed-table maintenance."""
