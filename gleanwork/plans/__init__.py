"""Operators composed into the stages a job runs end to end."""
