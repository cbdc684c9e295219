"""Whole flows and the workload they are checked and timed with."""
