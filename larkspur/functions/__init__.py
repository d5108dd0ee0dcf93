"""Part of larkspur."""
