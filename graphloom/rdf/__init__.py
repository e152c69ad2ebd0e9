"""RDF terms and the Turtle reader (driver only)."""
