"""Scalar functions over entity names, paths, values and text."""
