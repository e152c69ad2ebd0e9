"""The mapping language: model, templates, Turtle to rules."""
