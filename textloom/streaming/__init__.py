"""Streaming: the survey lists no streaming operator, so there is none here."""
