"""Labelled-corpus analytics as DataFrame-to-DataFrame functions."""
