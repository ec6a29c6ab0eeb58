"""Whole computations: matching, resolution, feed, planners and runs."""
