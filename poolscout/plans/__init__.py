"""Whole workflows: running an exploration and analysing finished runs."""
