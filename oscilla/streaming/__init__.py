"""Structured Streaming: sessions, scoring, life cycle; each agrees with its batch operator."""
