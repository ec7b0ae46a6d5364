"""textloom: text-corpus and social-graph analytics expressed as Spark DataFrame programs."""
