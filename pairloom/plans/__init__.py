"""Registered queries: each joins operators into a plan over the tables."""
