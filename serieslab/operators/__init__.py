"""Operators: DataFrame to DataFrame, over all subjects at once."""
