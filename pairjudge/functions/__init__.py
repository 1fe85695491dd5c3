"""functions of pairjudge."""
