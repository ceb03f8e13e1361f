"""Readers and writers of portfolio, scored, counterfactual and metrics tables."""
