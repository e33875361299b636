"""Tests of the operators for training text."""
