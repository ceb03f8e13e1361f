"""End-to-end runs: build a dataset, train and score, run a scenario, report."""
