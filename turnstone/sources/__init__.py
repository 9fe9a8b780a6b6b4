"""Readers of transcripts: discovery, lines, and one parser a harness, all as DataFrames."""
