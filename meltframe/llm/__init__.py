"""Operators for preparing language-model training data, and the stages of the pipeline built from them."""
