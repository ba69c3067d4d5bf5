"""Training-data operators: one module each, with its query and its SQL where SQL can say it."""
