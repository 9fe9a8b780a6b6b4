"""Coding-session analytics on Spark."""
