"""Readers and parsers that bring outside records into the contract's columns."""
