"""Operators for training-data problems; nothing outside this folder imports it."""
