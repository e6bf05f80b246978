"""Operators for preparing language-model training data, one module each.

Nothing else in ``attestry`` imports this subpackage.
"""
