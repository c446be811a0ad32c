"""Column functions: text and paths, vectors, descriptor scores, geometry and stable hashes."""
