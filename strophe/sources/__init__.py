"""Readers, and adapters from plain tables to the library's canonical ones."""
