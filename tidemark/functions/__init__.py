"""Column builders: text, numbers, vectors.  All are built-in expressions unless they say otherwise."""
