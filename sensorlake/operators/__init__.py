"""DataFrame operators on sensor streams and trajectories."""
