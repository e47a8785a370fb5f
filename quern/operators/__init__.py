"""Operators over events, intervals, trees, sets and folds."""
