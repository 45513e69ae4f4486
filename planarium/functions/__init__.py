"""Part of the planar cell engine."""
