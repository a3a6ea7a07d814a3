"""Operators for preparing language-model training data, independent of the rule engine."""
