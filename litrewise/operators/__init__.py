"""DataFrame operators; each takes frames and keyword parameters and returns a frame."""
