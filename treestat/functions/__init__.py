"""Scalar expressions of the catalogue, all as ``Column -> Column``."""
