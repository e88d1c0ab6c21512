"""Operators: cleaning, splitting, balancing, neighbours, metrics, exploration, models."""
