"""Readers for span logs, run manifests, prompts, labels and ledgers."""
