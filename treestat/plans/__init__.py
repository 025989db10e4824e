"""Input tables derived from the given data, and their SQL twins for the oracle."""
