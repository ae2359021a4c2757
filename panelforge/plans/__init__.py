"""Whole jobs, the views they run on, and the registered queries."""
