"""Compositions of operators: whole runs, driver views and driver queries."""
