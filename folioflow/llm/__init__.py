"""Operators for training corpora: each document is a panel script, prompt, log or captured page of a run."""
