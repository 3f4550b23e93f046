"""Gradings of papers that arrive one after the other."""
