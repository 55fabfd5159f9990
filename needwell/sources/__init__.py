"""Readers that bring outside data into declared schemas."""
