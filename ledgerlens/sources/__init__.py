"""Reading, checking and writing finance tables."""
