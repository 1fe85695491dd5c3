"""operators of pairjudge."""
