"""Operators for building training data: each module holds one operator, ``registry`` its queries."""
