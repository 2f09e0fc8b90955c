"""Whole workflows: cube builds and the result tables behind each view."""
