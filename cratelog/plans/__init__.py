"""Typed chains of stages."""
