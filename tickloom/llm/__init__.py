"""Operators for text corpora: leaked evaluation passages, mixtures by target weights, subjects."""
