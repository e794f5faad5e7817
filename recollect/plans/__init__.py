"""Registered queries: operators applied to the store's tables."""
