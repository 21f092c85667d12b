"""Structured Streaming forms: exact, parallel and keyed novelty detection, and stream windows."""
