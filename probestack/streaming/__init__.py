"""Structured Streaming forms; beyond what batch parity needs."""
