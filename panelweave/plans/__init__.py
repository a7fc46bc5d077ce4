"""End-to-end flows built from the operators: silver, gold, training."""
