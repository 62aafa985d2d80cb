"""Registered queries of the engine on the given star-schema tables."""
