"""Readers of manifests, generated transcripts and side tables."""
