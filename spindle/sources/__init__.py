"""Tables, what is loaded into them, and text results."""
