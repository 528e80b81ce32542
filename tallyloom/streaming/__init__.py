"""Structured Streaming forms: transcripts that arrive in a folder, and rates over an event stream."""
