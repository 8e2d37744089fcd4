"""Selectors, models, nested cross-validation, swarm search and explanations."""
