"""Structured Streaming: timelines into an event table as files arrive, and windowed event counts."""
