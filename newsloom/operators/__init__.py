"""Set operators: ordered selection, upserts, lifecycles, similarity joins, evidence and scores."""
