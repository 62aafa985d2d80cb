"""Operators for training data: mixing, scanning, scoring, packing, search, sharding, extraction, joins."""
