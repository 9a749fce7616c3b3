"""Continuous forms of scoring, distributions and pacing."""
