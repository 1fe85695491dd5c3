"""sources of pairjudge."""
