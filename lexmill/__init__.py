"""lexmill: corpus preparation and analysis for language-model training on Spark."""
