"""Readers, writers and the fixture adapter."""
