"""Text formats of examples, models, matches and raw connection records."""
