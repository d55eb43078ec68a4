"""Live stacking of arriving frames."""
