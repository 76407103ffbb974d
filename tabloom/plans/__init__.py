"""Decisions made from statistics: identifiers, targets, plans, scores, and the full run."""
