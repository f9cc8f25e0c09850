"""Readers and writers of tables, tiles and contracts."""
