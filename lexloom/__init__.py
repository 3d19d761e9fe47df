"""lexloom: text annotation, lexicon search and corpus preparation on Spark."""
