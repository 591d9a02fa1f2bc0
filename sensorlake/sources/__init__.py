"""Readers and writers of recordings and trajectories."""
