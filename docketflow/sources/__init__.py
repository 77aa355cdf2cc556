"""Tables the engine reads."""
