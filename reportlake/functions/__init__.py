"""Column-to-column functions; none of them causes a shuffle."""
