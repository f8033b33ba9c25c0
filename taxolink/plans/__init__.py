"""Stand-in tables and driver queries composed from the operators."""
