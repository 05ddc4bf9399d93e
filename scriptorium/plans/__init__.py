"""Compositions of operators, and the adapters that give the driver tables domain shape."""
