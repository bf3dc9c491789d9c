"""Queries the driver runs, each beside the SQL that must give the same rows."""
