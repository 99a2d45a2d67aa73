"""functions of the layout engine."""
