"""Registered plans: the library's own queries with their SQL oracles."""
