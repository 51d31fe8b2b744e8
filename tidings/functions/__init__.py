"""Column functions: text, dates, urls, publishers, vectors, scores."""
