"""DataFrame operators: selection, joins, scoring, slices, layout statistics, needles, inference."""
