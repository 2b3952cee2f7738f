"""Operators for building language-model training data; nothing else in booktext imports this."""
