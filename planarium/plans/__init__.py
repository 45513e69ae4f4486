"""Query plans built from the operators."""
