"""Lazy DataFrame -> DataFrame analytics operators."""
