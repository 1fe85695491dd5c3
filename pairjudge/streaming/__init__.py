"""streaming of pairjudge."""
