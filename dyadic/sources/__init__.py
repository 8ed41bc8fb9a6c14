"""Reading, checking and writing the long feature tables."""
