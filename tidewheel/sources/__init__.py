"""Readers for feeds, listings and record trees."""
