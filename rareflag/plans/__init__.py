"""Plans: preprocessing pipeline, search, scoring, evaluation, named queries."""
