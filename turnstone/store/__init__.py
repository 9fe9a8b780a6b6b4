"""Summaries that are kept between runs."""
