"""Stand-in series, registered queries and whole flows."""
