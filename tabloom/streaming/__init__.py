"""Streams: windowed profiles and scoring."""
