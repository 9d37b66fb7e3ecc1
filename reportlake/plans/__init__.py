"""Named queries and jobs composed from the operators."""
