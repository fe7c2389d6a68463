"""Readers, writers and the mapping from supplied tables to domain tables."""
