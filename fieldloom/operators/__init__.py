"""DataFrame operators on meshes and fields."""
