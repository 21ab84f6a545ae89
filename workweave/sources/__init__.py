"""Readers and fixed reference tables."""
