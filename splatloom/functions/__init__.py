"""Column builders: rotations, cameras, spherical harmonics, packing and losses."""
