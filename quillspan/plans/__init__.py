"""Registered queries: thin compositions of operators over the driver tables, with SQL."""
