"""Operators over the chain, price and feature tables."""
