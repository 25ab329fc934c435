"""DataFrame operators: parsing, candidates, matching, reports, re-ranking."""
