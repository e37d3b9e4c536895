"""Training-data operators: line dedup, token counts, quality and toxicity scores, chat
formatting, similarity join, URL rules, decontamination and packing.

Nothing outside this subpackage imports it.
"""
