"""Passes over a library: frames in, frames out."""
