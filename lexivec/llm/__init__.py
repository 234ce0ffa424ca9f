"""Training-data operators: token counts, toxicity, chat formatting, near-duplicates, BPE, decontamination, line
dedup, fingerprints, web archives and substring dedup. Nothing outside this subpackage imports it."""
