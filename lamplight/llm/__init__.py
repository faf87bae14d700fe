"""Training-data operators: ten corpus-scale stages and their registered queries."""
