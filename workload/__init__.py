"""Registered queries with their oracle SQL, over proxy views of the test tables."""
