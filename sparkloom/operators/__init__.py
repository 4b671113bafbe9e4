"""DataFrame operators: tables, ranking, validation, synchronisation, state, statistics, trees."""
