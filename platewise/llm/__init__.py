"""Operators for preparing language-model training data.

One module per operator, each a DataFrame-in / DataFrame-out function with its own
general interface; ``queries.py`` holds the thin registered queries and their SQL.
"""
