"""Scalar expressions over residue codes."""
