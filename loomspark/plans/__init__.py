"""Planning of query chains, and the registered queries of each area."""
