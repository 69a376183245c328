"""Documents in, typed rows out."""
