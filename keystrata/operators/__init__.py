"""Operators over op logs and states."""
