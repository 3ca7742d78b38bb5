"""Stateful reassembly of TCP streams and IP fragments, by key."""
