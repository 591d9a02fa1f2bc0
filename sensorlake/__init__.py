"""Multi-sensor recordings and the trajectories derived from them, as Spark DataFrame operators."""
