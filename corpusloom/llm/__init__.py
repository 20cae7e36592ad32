"""Operators for preparing language-model training data at corpus scale.

Nothing outside this folder imports it; the registry of its queries is in ``queries``.
"""
