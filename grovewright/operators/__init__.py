"""Operators over the evidence model: entity, occurrence, assertion, observation, and the history tables."""
