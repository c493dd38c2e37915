"""Sketches and similarity of sets, as DataFrame queries."""
