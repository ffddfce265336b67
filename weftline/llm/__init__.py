"""Training-data operators: quality, near-duplicates, mixing, licences, WARC, BPE and main-text extraction.

Nothing outside this package imports it; ``weftline.llm.queries`` holds the registered queries.
"""
