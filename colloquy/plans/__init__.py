"""Shared plans: posts with their scores, and the oracle's equivalent."""
