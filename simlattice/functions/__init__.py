"""Scalar functions as Column builders, and the few kernels without a relational form."""
