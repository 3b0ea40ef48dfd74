"""Operators for preparing language-model training data at corpus scale.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
when it is present.
"""
