"""fieldloom: scalar and vector fields on unstructured meshes, as Spark jobs."""

SENTINEL = -99999.0
"""In-band marker of a missing sample in raw field files; NULL inside the engine."""
