"""DataFrame-to-DataFrame operators: extraction, merges, catalogue, structuring."""
