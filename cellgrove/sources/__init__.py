"""Readers, writers and the terrain views over a folder of tables."""
