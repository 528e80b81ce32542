"""Training-data operators: ten corpus-scale steps that share no code with the rest of the package."""
