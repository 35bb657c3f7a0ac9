"""Micro-batch decisions and their monitoring."""
