"""Operators for preparing language-model training data. Nothing else in procloom imports this subpackage."""
