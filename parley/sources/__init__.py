"""Readers and writers of conversations."""
