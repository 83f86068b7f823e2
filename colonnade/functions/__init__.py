"""Scalar function libraries: strings, dates, math, numbers."""
