"""Column functions: identities, closed vocabularies, paths, selectors."""
