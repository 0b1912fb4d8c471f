"""Operators from DataFrame to DataFrame: features, index, neighbours, decisions, evaluation."""
