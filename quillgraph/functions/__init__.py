"""Column expressions over terms and scores."""
