"""Whole queries: the public tools as DataFrame functions, and the registered queries with their SQL."""
