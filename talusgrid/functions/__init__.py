"""Column builders: text, time and identifier expressions that stay inside Catalyst."""
