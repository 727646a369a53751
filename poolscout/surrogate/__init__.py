"""Models that predict every candidate's score from its features."""
