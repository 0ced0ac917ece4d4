"""DataFrame operators; every one takes its key and value columns as parameters."""
