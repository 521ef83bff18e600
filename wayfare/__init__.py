"""Trajectory and event analytics on Spark: tracks in, events, measures and cohort tables out."""
