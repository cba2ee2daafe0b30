"""Graph data: triples, Turtle, SPARQL, profile and inference."""
