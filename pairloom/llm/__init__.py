"""Operators for building training corpora: each module is one operator, ``queries`` applies them to the standard tables."""
