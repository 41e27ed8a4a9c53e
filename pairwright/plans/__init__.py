"""Ready-made plans: input tables derived from the given ones, the registered queries, and their SQL."""
