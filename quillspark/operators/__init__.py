"""Operators: DataFrame to DataFrame, or expressions over one document's row."""
