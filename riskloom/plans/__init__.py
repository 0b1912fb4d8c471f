"""Whole plans: from requests to answers, from events to an index."""
