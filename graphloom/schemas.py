"""Table schemas of a code graph and its fixed vocabulary."""

from __future__ import annotations

NODE_TYPES = ("module", "class", "function", "method", "import", "variable")
EDGE_TYPES = ("defines", "calls", "imports", "contains", "inherits", "references")  # open: front ends may add others

#: Path of nodes that stand for names which no parsed file defines.
UNRESOLVED = "<unresolved>"

NODES = "id string, node_type string, name string, title string, file_path string, line_start int, line_end int, signature string, keywords string"
EDGES = "source_id string, target_id string, edge_type string"
EMBEDDINGS = "node_id string, vector array<float>, dims int, embedded_at timestamp"
MANIFEST = "file_path string, content_hash string, indexed_at timestamp"
SNAPSHOT = "snapshot_hash string, indexed_at timestamp, file_count long, node_count long, edge_count long, root_path string"
PARSED = f"kind string, {NODES}, source_id string, target_id string, edge_type string"

NODE_COLUMNS = [x.split()[0] for x in NODES.split(", ")]
EDGE_COLUMNS = [x.split()[0] for x in EDGES.split(", ")]
#: Columns of a node that an upsert replaces; the others are its identity.
MUTABLE = ("title", "line_end", "signature", "keywords")
