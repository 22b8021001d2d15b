"""Training-data operators: quality, near and exact duplicates, tokens, licences, personal data, urls, contamination."""
