"""Context retrieval over Spark DataFrames: chunking, candidate channels, rules, fusion, packing, rebuilds."""
