"""A document retrieval engine on Spark DataFrames: chunks, sparse and dense vectors, hybrid search, reranking."""
