from fraudlens.sources.tsv import (CONTENT_SCHEMA, GRAPH_SCHEMA, META_SCHEMA,
                                   read_content, read_graph, read_metadata)
from fraudlens.sources.adapters import (load_table, reviews_docs, reviews_events,
                                        reviews_orders, split_content_meta)
from fraudlens.sources.sinks import preview, write_embeddings, write_feature_matrix

__all__ = ["CONTENT_SCHEMA", "META_SCHEMA", "GRAPH_SCHEMA", "read_content",
           "read_metadata", "read_graph", "load_table", "reviews_orders",
           "reviews_events", "reviews_docs", "split_content_meta", "preview",
           "write_embeddings", "write_feature_matrix"]
