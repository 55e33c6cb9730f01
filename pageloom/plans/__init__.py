"""Whole plans: a crawl with its outputs, and the registered queries."""
