"""Registered queries and the SQL that each one is compared with."""
