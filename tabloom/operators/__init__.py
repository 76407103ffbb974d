"""Distributed table computations."""
