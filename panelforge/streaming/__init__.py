"""The labelling job on arriving files."""
