"""Multi-step jobs built from the operators: marts, training, evaluation, causal scenarios."""
