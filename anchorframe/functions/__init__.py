"""Scalar and order-dependent functions."""
