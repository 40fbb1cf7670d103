"""Operators for building language-model training data at cluster scale.

Nothing outside this package imports it; the driver contract adds its queries
only where it can be imported.
"""
