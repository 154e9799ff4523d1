class UnsupportedQueryError(Exception):
    """Raised for work that the engine does not do; nothing falls back silently."""
