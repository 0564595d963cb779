"""Stores and landed payloads."""
