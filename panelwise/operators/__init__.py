"""DataFrame-to-DataFrame operators: joins, membership, totals, ordering."""
