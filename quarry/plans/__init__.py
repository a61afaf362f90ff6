"""Query plans over the driver tables."""
