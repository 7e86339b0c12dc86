"""tokenloom: token-level hybrid text search and corpus processing on Spark."""
