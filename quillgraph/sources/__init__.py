"""Readers and writers: Turtle, source trees, notebooks, configuration."""
