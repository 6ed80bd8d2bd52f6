"""Readers and writers for alignments, embeddings, lexicons, word pairs, matrices and features."""
