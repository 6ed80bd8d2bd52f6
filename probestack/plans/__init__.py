"""Whole plans: experiments by name, and the query catalogue."""
