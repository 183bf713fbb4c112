"""Whole-universe jobs composed from the operators."""
