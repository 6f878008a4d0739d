"""Runnable jobs over given tables: each is a function of a session, and a command line around it."""
