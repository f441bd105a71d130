"""DataFrame operators: chunking, snapshot diffs, lexical and vector retrieval, fusion, context, summaries."""
