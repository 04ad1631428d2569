"""Session set-up, shared scratch storage and other plan-level helpers."""
