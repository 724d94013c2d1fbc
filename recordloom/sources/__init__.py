"""Where tracks and side tables come from, and where they are kept."""
