"""Catching up on interval streams behind per-camera watermarks."""
