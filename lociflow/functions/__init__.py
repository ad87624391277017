"""Column functions and the condition compiler."""
