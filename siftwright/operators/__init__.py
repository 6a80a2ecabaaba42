"""DataFrame operators: screens, joins, aggregates, ranking, graphs and gates."""
