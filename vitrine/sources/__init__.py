"""Readers and the shared work area."""
