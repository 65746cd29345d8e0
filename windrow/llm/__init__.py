"""Training-data operators: extraction, classifiers, joins, search, formatting and mixing."""
