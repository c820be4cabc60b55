"""Join shapes, graph fixpoints and group-wise picks that the passes are written in."""
