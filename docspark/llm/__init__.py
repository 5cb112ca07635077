"""Training-data operators: tokenising, scoring, deduplicating and packing document collections.

Nothing outside this subpackage imports it; it can be deleted without touching the rest of the engine.
"""
