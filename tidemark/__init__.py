"""Windowed event analytics as plain DataFrame-to-DataFrame functions."""
