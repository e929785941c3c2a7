"""Schemas of the tables the engine exchanges (row identity is an explicit id)."""

POSITIONS = "vid bigint, pos array<double>"
CELLS = "cid bigint, verts array<bigint>"
EDGES = "src bigint, dst bigint"
NEIGHBOUR_TABLE = "vid bigint, nbrs array<int>"
FIELD = "var string, t int, vid bigint, val float"
VECTOR_FIELD = "vid bigint, u float, v float, w float"
LAYOUT = "vid bigint, part bigint, slot int"
CRITICAL_POINTS = "cid bigint, x double, y double, z double, kind int"

BLOB = (
    "part bigint, tb int, var string, method string, n int, steps int, "
    "eb array<double>, params map<string,double>, payload binary"
)
