"""DataFrame operators over events, jobs, reviews and rules."""
