"""DataFrame-to-DataFrame operators; each returns a lazy DataFrame."""
