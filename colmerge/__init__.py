"""Column-level change data on Spark: change logs, conflict resolution, deltas, views and notifications."""
