"""DataFrame operators over the article table and the tables derived from it."""
