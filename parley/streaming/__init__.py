"""Incremental forms: the search index, sessions and tapbacks as streams, and log tailing."""
