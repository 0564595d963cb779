"""Whole feature tables and the jobs that keep them."""
