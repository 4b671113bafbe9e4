"""Stateful operators: one state machine each, walked over sorted rows in batch and kept as keyed state in a stream."""
