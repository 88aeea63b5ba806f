"""Readers of document bundles and stores of index generations."""
