"""procloom: document and process-graph analytics written as PySpark DataFrame programs."""
