"""Operators over DataFrames: relational, statistical and machine-learning."""
