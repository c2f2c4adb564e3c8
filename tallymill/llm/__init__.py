"""Operators for preparing language-model training text, each on DataFrames of whole documents."""
