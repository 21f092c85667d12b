"""Whole programs: offline training, online novelty detection as a batch replay."""
