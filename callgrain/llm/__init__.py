"""Operators for building language-model training data.

Nothing outside this folder imports it; ``__spark_entry__`` adds the queries if it is there.
"""
