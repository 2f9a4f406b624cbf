"""Tests of the operators on training data."""
