"""Training-data operators: deduplication, formatting, filtering, packing.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
