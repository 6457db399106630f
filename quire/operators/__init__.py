"""DataFrame to DataFrame: the catalogue, its edits, their history, lookups and summaries."""
