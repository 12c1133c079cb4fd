"""Spark jobs for analysing mail and chat archives across many accounts and rooms."""
