"""Distributed operators: one DataFrame in, one (usually small) DataFrame out."""
