"""Readers and writers of libraries, label tables and run logs."""
