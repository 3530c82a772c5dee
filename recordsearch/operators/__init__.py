"""DataFrame-to-DataFrame operators; all lazy."""
