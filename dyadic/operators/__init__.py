"""DataFrame operators over long feature tables."""
