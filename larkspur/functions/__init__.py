"""Part of larkspur; see the README for the map of modules."""
