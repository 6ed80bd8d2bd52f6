"""Relational operators over tokens, frames, vectors and scores."""
