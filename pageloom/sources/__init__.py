"""Inputs, written intermediate tables and sinks."""
