"""Column functions of the key-value model."""
