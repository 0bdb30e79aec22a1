"""Operators on DataFrames: features, profiles, relevance, few-shot sets, evaluation, generation."""
