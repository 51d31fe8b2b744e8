"""Training-data operators: quality, secrets, licences, tokens, chat pairs, contamination, mixing, copies."""
