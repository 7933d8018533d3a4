"""Registered queries and the input views they share."""
